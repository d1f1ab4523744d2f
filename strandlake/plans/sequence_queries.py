"""Queries of the sequence operators. Texts stand for sequences: their letters A, C, G and T."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import assembly as asm
from ..operators import sequence as sq
from ..operators import store as st
from ..shared import stored
from ..sources import readers as rd
from . import model as m
from .registry import query

_DNA = "regexp_replace(upper({}), '[^ACGT]', '', 'g')"


def as_dna(c: str):
    return F.regexp_replace(F.upper(c), "[^ACGT]", "")


@query("reverse_complement", f"SELECT doc_id, reverse(translate({_DNA.format('text')}, 'ACGT', 'TGCA')) AS rc FROM documents")
def _(t):
    """Section 2.8: reverse complement."""
    return t.documents.select("doc_id", dna.reverse_complement(as_dna("text")).alias("rc"))


@query("gc_at_score", f"""WITH d AS (SELECT doc_id, {_DNA.format('text')} AS s FROM documents), n AS (SELECT doc_id, length(s) AS n, length(replace(replace(s, 'A', ''), 'T', '')) AS gc FROM d)
SELECT doc_id, CAST(2 * (n - gc) + 4 * gc AS INTEGER) AS score, CASE WHEN n > 0 THEN round(gc / CAST(n AS DOUBLE), 6) END AS gc FROM n""")
def _(t):
    """Section 2.8: melting score and GC share."""
    s = as_dna("text")
    return t.documents.select("doc_id", dna.gcat_score(s).alias("score"), F.round(dna.gc_fraction(s), 6).alias("gc"))


@query("kmer_counts", f"""WITH d AS (SELECT {_DNA.format('text')} AS s FROM benchmark), k AS (SELECT substr(s, CAST(i AS BIGINT) + 1, 5) AS kmer FROM (SELECT s, unnest(range(length(s) - 4)) AS i FROM d WHERE length(s) >= 5)), f AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1)
SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM f UNION ALL SELECT reverse(translate(kmer, 'ACGT', 'TGCA')), n FROM f) GROUP BY 1""")
def _(t):
    """K-mers of both strands."""
    return sq.kmer_counts(t.benchmark.select(as_dna("text").alias("s")), "s", 5)


@query("repeated_substrings", "WITH k AS (SELECT substr(text, CAST(i AS BIGINT) + 1, 12) AS substring FROM (SELECT text, unnest(range(length(text) - 11)) AS i FROM benchmark WHERE length(text) >= 12)) SELECT substring, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1")
def _(t):
    """Substrings that occur more than once."""
    return sq.repeated_substrings(t.benchmark, "text", 12)


_CYCLE = f"WITH d AS (SELECT doc_id % 50 AS grp, {_DNA.format('text')} AS s FROM documents), c AS (SELECT grp, CAST(i AS INTEGER) AS pos, substr(s, CAST(i AS BIGINT) + 1, 1) AS b FROM (SELECT grp, s, unnest(range(length(s))) AS i FROM d)) "


@query("consensus", _CYCLE + """, n AS (SELECT grp, pos, b, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT grp, pos, max(n) AS top FROM n GROUP BY 1, 2), w AS (SELECT grp, pos, CASE WHEN count(*) = 1 THEN min(b) ELSE 'x' END AS b FROM n JOIN m USING (grp, pos) WHERE n = top GROUP BY 1, 2)
SELECT grp, string_agg(b, '' ORDER BY pos) AS consensus FROM w GROUP BY 1""")
def _(t):
    """Majority sequence of a group, 'x' on ties."""
    d = t.documents.select((F.col("doc_id") % 50).alias("grp"), as_dna("text").alias("s"))
    return sq.consensus(d, ["grp"], "s")


@query("base_counts", _CYCLE + """SELECT pos AS cycle, count(*) AS depth, count(*) FILTER (b = 'A') AS "A", count(*) FILTER (b = 'C') AS "C", count(*) FILTER (b = 'G') AS "G", count(*) FILTER (b = 'T') AS "T", CAST(0 AS BIGINT) AS "N" FROM c GROUP BY 1""")
def _(t):
    """Bases per cycle."""
    return sq.base_counts(t.documents.select(as_dna("text").alias("s")), [], "s")


@query("quality_per_cycle", """WITH c AS (SELECT CAST(i AS INTEGER) AS cycle, ascii(substr(p_name, CAST(i AS BIGINT) + 1, 1)) - 33 AS q FROM (SELECT p_name, unnest(range(length(p_name))) AS i FROM part)) SELECT cycle, count(*) AS n, round(avg(q), 6) AS mean_quality, CAST(min(q) AS INTEGER) AS min_quality FROM c GROUP BY 1""")
def _(t):
    """Qualities per cycle."""
    return sq.quality_stats(t.part, "p_name").withColumn("mean_quality", F.round("mean_quality", 6))


@query("sequence_similarity", f"""WITH d AS (SELECT doc_id, {_DNA.format('text')} AS a, substr({_DNA.format('text')}, 3) AS b FROM documents), c AS (SELECT doc_id, substr(a, CAST(i AS BIGINT), 1) AS x, substr(b, CAST(i AS BIGINT), 1) AS y FROM (SELECT *, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM d))
SELECT d.doc_id, CAST(count(*) FILTER (x = y) AS INTEGER) AS matches, CAST(count(x) AS INTEGER) AS testable FROM d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def _(t):
    """Matches over testable positions, each text against itself two bases on."""
    s = as_dna("text")
    return t.documents.select("doc_id", dna.similarity(s, F.substring(s, F.lit(3), F.length(s))).alias("x")).select("doc_id", "x.matches", "x.testable")


@query("hamming_barcode", """WITH r AS (SELECT DISTINCT upper(substr(p_name, 1, 6)) AS seen FROM part), b AS (SELECT upper(substr(p_name, 1, 6)) AS barcode, 'b' || p_partkey AS name FROM part WHERE p_partkey < 12),
d AS (SELECT seen, name, greatest(length(seen), length(barcode)) - (SELECT count(*) FROM range(1, least(length(seen), length(barcode)) + 1) t(i) WHERE substr(seen, CAST(i AS BIGINT), 1) = substr(barcode, CAST(i AS BIGINT), 1)) AS d FROM r, b),
m AS (SELECT seen AS s, min(d) AS least FROM d GROUP BY 1) SELECT seen AS barcode, CAST(least AS INTEGER) AS distance, CASE WHEN least <= 2 AND count(*) = 1 THEN min(name) ELSE 'unknown' END AS name FROM d JOIN m ON seen = s WHERE d.d = least GROUP BY seen, least""")
def _(t):
    """The one nearest barcode, ties unknown."""
    code = F.upper(F.substring("p_name", 1, 6))
    sheet = t.part.filter("p_partkey < 12").select(code.alias("barcode"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("name"))
    return sq.match_barcodes(t.part.select(code.alias("barcode")).distinct(), sheet, 2).select("barcode", "distance", "name")


_MEMS = """WITH q AS (SELECT doc_id AS query, text AS seq FROM documents), qk AS (SELECT query, i, substr(seq, CAST(i AS BIGINT) + 1, 30) AS k FROM (SELECT query, seq, unnest(range(length(seq) - 29)) AS i FROM q WHERE length(seq) >= 30)),
rk AS (SELECT item_id AS ref, i, substr(text, CAST(i AS BIGINT) + 1, 30) AS k FROM (SELECT item_id, text, unnest(range(length(text) - 29)) AS i FROM benchmark WHERE length(text) >= 30)),
h AS (SELECT query, ref, rk.i - qk.i AS diag, qk.i AS q_pos FROM qk JOIN rk USING (k)), s AS (SELECT *, q_pos - row_number() OVER (PARTITION BY query, ref, diag ORDER BY q_pos) AS island FROM h),
m AS (SELECT query, ref, diag, min(q_pos) AS q_start, max(q_pos) - min(q_pos) + 30 AS len FROM s GROUP BY query, ref, diag, island) """


def _mems(t):
    q = t.documents.select(F.col("doc_id").alias("query"), F.col("text").alias("seq"))
    return q, t.benchmark.select(F.col("item_id").alias("ref"), F.col("text").alias("seq"))


@query("maximal_matches", _MEMS + "SELECT query, ref, CAST(q_start AS INTEGER) AS q_start, CAST(q_start + diag AS INTEGER) AS r_start, CAST(len AS INTEGER) AS len FROM m")
def _(t):
    """Maximal exact matches between texts."""
    return sq.maximal_matches(*_mems(t), 30)


@query("unique_matches", _MEMS + "SELECT query, ref, CAST(q_start AS INTEGER) AS q_start, CAST(q_start + diag AS INTEGER) AS r_start, CAST(len AS INTEGER) AS len FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.query = a.query AND (b.ref <> a.ref OR b.diag <> a.diag) AND b.q_start <= a.q_start AND b.q_start + b.len >= a.q_start + a.len)")
def _(t):
    """Matches that are unique in the reference."""
    return sq.unique_matches(*_mems(t), 30).select("query", "ref", "q_start", "r_start", "len")


@query("mappability")
def _(t):
    """Shortest unique lengths of every base."""
    return sq.mappability(t.benchmark.select(F.col("item_id").alias("ref"), as_dna("text").alias("seq")).filter("seq <> ''"))


@query("tandem_repeats")
def _(t):
    """Tandem repeats with minimal motifs."""
    return sq.tandem_repeats(t.documents.select(F.col("doc_id").alias("ref"), as_dna("text").alias("seq")))


@query("parsed_reads", f"""WITH d AS (SELECT doc_id, {_DNA.format('text')} AS s FROM documents), r AS (SELECT doc_id, substr(s, 1, 4) AS umi, substr(s, 5, 6) AS code, substr(s, 11) AS rest FROM d),
p AS (SELECT doc_id, rest, unnest(range(length(rest))) AS i FROM r WHERE rest <> ''), c AS (SELECT doc_id, i, [CASE WHEN i + k > length(rest) THEN 2 WHEN substr(rest, CAST(i + k AS BIGINT), 1) <> substr('GATTACA', CAST(k AS BIGINT), 1) THEN 1 ELSE 0 END for k in range(1, 8)] AS bad FROM p),
n AS (SELECT doc_id, i, len(list_filter(range(1, 8), lambda k: list_sum(bad[1:k]) <= 1)) AS n FROM c), b AS (SELECT doc_id, max(n) AS n, arg_max(i, n * 1000000000 - i) AS i FROM n GROUP BY 1)
SELECT doc_id, umi, code, CASE WHEN n > 4 THEN substr(rest, 1, CAST(i AS BIGINT)) END AS key, CAST(coalesce(n, 0) AS INTEGER) AS matched FROM r LEFT JOIN b USING (doc_id)""")
def _(t):
    """Fixed parts of a read, and the key before a pattern."""
    rows = t.documents.select("doc_id", F.explode(F.array(as_dna("text"))).alias("s"))
    return rows.select("doc_id", sq.parse_read(F.col("s"), [("umi", 4), ("code", 6)], "GATTACA").alias("r")).select("doc_id", "r.umi", "r.code", "r.rest.key", "r.rest.matched")


@query("pileup_genotypes", f"""WITH r AS (SELECT doc_id AS pair_id, doc_id % 5 AS chr, doc_id % 7 AS p, {_DNA.format('text')} AS s FROM documents), c AS (SELECT pair_id, chr, p + i AS pos, substr(s, CAST(i AS BIGINT) + 1, 1) AS base FROM (SELECT *, unnest(range(length(s))) AS i FROM r)),
n AS (SELECT chr, pos, base, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY chr, pos) AS total FROM n) SELECT chr, pos, CAST(total AS BIGINT) AS total, string_agg(base, '/' ORDER BY base) AS call FROM k WHERE n >= 2 AND n >= 0.3 * total GROUP BY 1, 2, 3""")
def _(t):
    """Bases over positions and calls."""
    r = t.documents.select(F.col("doc_id").alias("pair_id"), (F.col("doc_id") % 5).alias("chr"), (F.col("doc_id") % 7).alias("pos"), as_dna("text").alias("seq"))
    return sq.genotype(sq.pileup(r), 2, 0.3)


_BUILT = f"""WITH r AS (SELECT doc_id, {_DNA.format('text')} AS seq FROM documents WHERE text IS NOT NULL), f AS (SELECT item_id, {_DNA.format('text')} AS seq FROM benchmark),
qk AS (SELECT doc_id, i, substr(seq, CAST(i AS BIGINT) + 1, 20) AS k FROM (SELECT doc_id, seq, unnest(range(length(seq) - 19)) AS i FROM r WHERE length(seq) >= 20)),
rk AS (SELECT item_id, i, substr(seq, CAST(i AS BIGINT) + 1, 20) AS k FROM (SELECT item_id, seq, unnest(range(length(seq) - 19)) AS i FROM f WHERE length(seq) >= 20)),
h AS (SELECT doc_id, item_id, rk.i - qk.i AS diag, qk.i AS p FROM qk JOIN rk USING (k)), s AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY p) AS island FROM h),
a AS (SELECT doc_id, item_id, diag, min(p) AS off, max(p) - min(p) + 20 AS len FROM s GROUP BY doc_id, item_id, diag, island),
m AS (SELECT * FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.doc_id = x.doc_id AND (y.item_id <> x.item_id OR y.diag <> x.diag) AND y.off <= x.off AND y.off + y.len >= x.off + x.len)),
c AS (SELECT doc_id, seq, unnest(range(length(seq))) AS i FROM r), u AS (SELECT c.doc_id, i, substr(seq, CAST(i AS BIGINT) + 1, 1) AS b FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND m.off <= i AND i < m.off + m.len))"""


def built_store(t):
    """The texts' letters as the reads of pairs, with their unique matches in the benchmark's."""
    reads = t.documents.filter("text IS NOT NULL").select(F.col("doc_id").alias("query"), as_dna("text").alias("seq"))
    found = sq.unique_matches(reads, t.benchmark.select(F.col("item_id").alias("ref"), as_dna("text").alias("seq")), 20)
    two, pair = F.col("query") % 2 == 1, F.floor(F.col("query") / 2)
    m = found.select(pair.alias("pair_id"), two.alias("read_2"), F.col("q_start").cast("int").alias("off"), F.col("len").cast("int").alias("len"), F.col("ref").cast("int").alias("chr"), F.col("r_start").cast("long").alias("pos"), F.lit(False).alias("flipped"))
    return st.build(reads.select(pair.alias("pair_id"), two.alias("read_2"), F.col("seq").alias("bases"), (F.length("seq") < 5).alias("bad")), m)


@query("store_build", _BUILT + """, e AS (SELECT doc_id // 2 AS pair_id, string_agg(b, '' ORDER BY doc_id, i) AS extra FROM u GROUP BY 1), n AS (SELECT doc_id // 2 AS pair_id, count(*) AS n FROM m GROUP BY 1)
SELECT doc_id // 2 AS pair_id, CAST(coalesce(sum(length(seq)) FILTER (doc_id % 2 = 0), 0) AS INTEGER) AS len1, CAST(coalesce(sum(length(seq)) FILTER (doc_id % 2 = 1), 0) AS INTEGER) AS len2, CAST(coalesce(any_value(n), 0) AS INTEGER) AS n_matches, coalesce(any_value(extra), '') AS extra
FROM r LEFT JOIN e ON e.pair_id = doc_id // 2 LEFT JOIN n ON n.pair_id = doc_id // 2 GROUP BY 1""")
def _(t):
    """D3: pairs, their matches and the bases beside them, from reads and matches."""
    return built_store(t).select("pair_id", "len1", "len2", F.size("matches").alias("n_matches"), "extra")


@query("store_reconstruct", f"SELECT doc_id // 2 AS pair_id, coalesce(max({_DNA.format('text')}) FILTER (doc_id % 2 = 0), '') AS seq1, coalesce(max({_DNA.format('text')}) FILTER (doc_id % 2 = 1), '') AS seq2 FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(t):
    """Reads rebuilt from the reference and the bases beside their matches."""
    ref = rd.reference_blocks(t.benchmark.select(F.col("item_id").alias("name"), as_dna("text").alias("seq")), 64)
    return st.reconstruct(built_store(t), ref.select(F.col("name").cast("int").alias("chr"), "block", "start", "seq"), 64)


@query("store_merge", f"WITH {m.DUPES} SELECT pair_id, sample, dupe FROM marked")
def _(t):
    """Stores of two parts as one, with duplicates across the parts."""
    s = t.store
    return st.merge([s.filter("pair_id % 2 = 0"), s.filter("pair_id % 2 <> 0")], ("sample",)).select("pair_id", "sample", "dupe")


@query("store_index", f"WITH {m.MUMS} SELECT chr, pos, pair_id, ord FROM mums")
def _(t):
    """Matches in genome order."""
    return st.index(t.store)


_EDGES = f"d AS (SELECT {_DNA.format('text')} AS s FROM benchmark), e AS (SELECT kmer, count(*) AS n FROM (SELECT substr(s, CAST(i AS BIGINT) + 1, {{k}}) AS kmer FROM (SELECT s, unnest(range(length(s) - {{k}} + 1)) AS i FROM d WHERE length(s) >= {{k}})) GROUP BY 1)"


def _graph(t, k):
    return asm.edges(t.benchmark.select(as_dna("text").alias("seq")), k)


@query("unitigs", f"""WITH RECURSIVE {_EDGES.format(k=9)}, x AS (SELECT kmer, n, substr(kmer, 1, 8) AS a, substr(kmer, 2) AS b FROM e), i AS (SELECT b AS node, count(*) AS n_in FROM x GROUP BY 1), o AS (SELECT a AS node, count(*) AS n_out FROM x GROUP BY 1),
node AS (SELECT coalesce(i.node, o.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM i FULL JOIN o ON i.node = o.node), through AS (SELECT node FROM node WHERE n_in = 1 AND n_out = 1),
w AS (SELECT kmer AS p, kmer AS unitig, b AS last, 1 AS n_edges, n AS total FROM x WHERE a NOT IN (SELECT node FROM through) UNION ALL SELECT w.p, w.unitig || substr(x.kmer, 9), x.b, w.n_edges + 1, w.total + x.n FROM w JOIN x ON x.a = w.last WHERE w.last IN (SELECT node FROM through)),
best AS (SELECT p, arg_max(unitig, n_edges) AS unitig, max(n_edges) AS n_edges, arg_max(total, n_edges) AS total, arg_max(last, n_edges) AS last FROM w GROUP BY 1)
SELECT unitig, CAST(n_edges AS BIGINT) AS n_edges, round(total / n_edges, 6) AS mean_count, f.n_in AS starts, l.n_out AS ends FROM best JOIN node f ON f.node = substr(p, 1, 8) JOIN node l ON l.node = last""")
def _(t):
    """Unbranched paths of the k-mer graph (the benchmark's has no cycle apart)."""
    return asm.unitigs(_graph(t, 9)).withColumn("mean_count", F.round("mean_count", 6))


@query("mismatch_counts", f"WITH {_EDGES.format(k=12)} SELECT a.kmer, CAST(hamming(a.kmer, b.kmer) AS INTEGER) AS mismatches, CAST(sum(b.n) AS BIGINT) AS n FROM e a JOIN e b ON hamming(a.kmer, b.kmer) <= 2 GROUP BY 1, 2")
def _(t):
    """K-mers within two mismatches of each k-mer."""
    g = stored(_graph(t, 12), "kmers")
    return asm.mismatch_counts(g.select("kmer"), g, 2)
