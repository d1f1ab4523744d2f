"""The match store: one row per pair, with the array of its matches.

A pair's matches are few (a read holds a bounded number of them), and nearly
everything is said inside a pair. So matches are brought together once, by one
shuffle on the pair, and read positions, support, mate support, duplicate keys
and bridges are array functions on that row: no window, no self-join, and no
second pass over the matches.

``store``: pair_id, the pair's own columns (len1, len2, bad1, bad2 and any more),
``matches``: array of (ord, chr, pos, len, flipped, read_2, off, read_len,
last_hit), in stored order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import anchor_position, invariant, read_position

SIGNATURE = ["chr1", "pos1", "high1", "chr2", "pos2", "high2", "offset"]
SUPPORT = ["anchor1_len", "anchor2_len", "mate1_len", "mate2_len"]
FIELDS = ["ord", "chr", "pos", "len", "flipped", "read_2", "off", "read_len", "last_hit"]
#: Least support of an anchor, and the largest mate distance.
MIN_SUPPORT, MAX_MATE_DISTANCE = 20, 1000


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: the optimiser would repeat a plain projection in every filter and function that uses it."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def nest(mums: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, matches) from a table with one row per match."""
    return mums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("matches"))


def laid_out(raw: DataFrame, gap: int = 1) -> DataFrame:
    """``matches`` from ``raw`` (array of chr, pos, len, flipped, read_2 in stored order): order, and places in the read, ``gap`` bases apart."""

    def taken(xs: Column, x: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda n, y: n + F.when(y["read_2"] == x["read_2"], y["len"] + gap).otherwise(0))

    def place(x: Column, i: Column) -> Column:
        later = F.exists(F.slice("raw", i + 2, F.size("raw")), lambda y: y["read_2"] == x["read_2"])
        return F.struct(
            i.cast("int").alias("ord"), x["chr"].alias("chr"), x["pos"].alias("pos"), x["len"].alias("len"), x["flipped"].alias("flipped"), x["read_2"].alias("read_2"),
            taken(F.slice("raw", 1, i), x).cast("int").alias("off"), (taken(F.col("raw"), x) - gap).cast("int").alias("read_len"), (~later).alias("last_hit"),
        )

    return once(raw, "matches", F.transform("raw", place)).drop("raw")


def flat(store: DataFrame, *columns: str) -> DataFrame:
    """One row per match: pair_id, further ``columns`` of the pair, and the match."""
    return store.select("pair_id", *columns, F.inline("matches"))


def read_lengths(store: DataFrame) -> DataFrame:
    """Add len1 and len2, 0 for a read without matches."""
    size = lambda two: F.coalesce(F.array_max(F.transform(F.filter("matches", lambda m: m["read_2"] == two), lambda m: m["read_len"])), F.lit(0)).cast("int")
    return store.withColumns({"len1": size(F.lit(False)), "len2": size(F.lit(True))})


def _readpos(m: Column) -> Column:
    return read_position(m["pos"], m["off"], m["len"], m["flipped"], m["read_len"])


def mark_duplicates(store: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Add ``dupe``: equal to the pair right before it in pair order.

    Pair order puts pairs with a first match in read 1 by (chr, read position),
    then by that of read 2; longer reads come first, bad ones last. Runs of equal
    pairs chain, and the first of a run stays unmarked. Equal pairs are neighbours
    in the order, so it is enough to number the rows of each group of equal pairs:
    groups are the partitions of the window, not whole samples.
    """
    first = lambda two: F.get(F.filter("matches", lambda m: m["read_2"] == two), F.lit(0))
    place = lambda m: F.when(m.isNotNull(), F.struct(m["chr"].alias("chr"), _readpos(m).alias("at")))
    rows = store.withColumns({"__a": place(first(F.lit(False))), "__b": place(first(F.lit(True)))})
    same = Window.partitionBy(*keys, "len1", "len2", "__a", "__b").orderBy("bad1", "bad2", "pair_id")
    mapped = F.col("__a").isNotNull() | F.col("__b").isNotNull()
    return rows.withColumn("dupe", mapped & (F.row_number().over(same) > 1)).drop("__a", "__b")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a one-element array is its scope."""
    return F.get(F.transform(F.array(value), body), 0)


def with_support(store: DataFrame) -> DataFrame:
    """Add to every match readpos, low_support and high_support (co-linear matches of its read), seen_low, seen_high and mate_support."""
    rows = once(store, "matches", F.transform("matches", lambda m: F.struct(*[m[c].alias(c) for c in FIELDS], _readpos(m).alias("readpos"))))
    zero = F.lit(0).cast("int")

    def support(m: Column) -> Column:
        same = F.filter("matches", lambda y: (y["readpos"] == m["readpos"]) & (y["read_2"] == m["read_2"]) & (y["chr"] == m["chr"]) & (y["flipped"] == m["flipped"]))

        def step(acc: Column, y: Column) -> Column:
            n = y["len"]
            return F.struct(
                (acc["before"] + F.when(y["ord"] < m["ord"], n).otherwise(0)).alias("before"), (acc["after"] + F.when(y["ord"] > m["ord"], n).otherwise(0)).alias("after"),
                F.least(acc["lo"], y["pos"]).alias("lo"), F.greatest(acc["hi"], y["pos"] + n - 1).alias("hi"),
            )

        start = F.struct(zero.alias("before"), zero.alias("after"), m["pos"].alias("lo"), (m["pos"] + m["len"] - 1).alias("hi"))
        # most matches are alone on their line
        around = _bound(same, lambda ys: F.when(F.size(ys) == 1, start).otherwise(F.aggregate(ys, start, step)))
        return _bound(around, lambda s: F.struct(
            *[m[c].alias(c) for c in FIELDS], m["readpos"].alias("readpos"), (m["len"] + F.when(m["flipped"], s["after"]).otherwise(s["before"])).cast("int").alias("low_support"),
            (m["len"] + F.when(m["flipped"], s["before"]).otherwise(s["after"])).cast("int").alias("high_support"), s["lo"].alias("seen_low"), s["hi"].alias("seen_high"), mates(m, s["lo"], s["hi"]).alias("mate_support"),
        ))

    def mates(m: Column, low: Column, high: Column) -> Column:
        """An ordered fold over the mate's matches, from the last to the first, that keeps the range seen so far."""
        own = F.filter("matches", lambda x: (x["read_2"] != m["read_2"]) & (x["chr"] == m["chr"]) & (x["flipped"] != m["flipped"]))

        def step(acc: Column, x: Column) -> Column:
            end = x["pos"] + x["len"] - 1
            far = F.when(~m["flipped"], (end <= acc["hi"]) | (x["pos"] > m["pos"] + MAX_MATE_DISTANCE)).otherwise((x["pos"] >= acc["lo"]) | (m["pos"] > x["pos"] + MAX_MATE_DISTANCE))
            gain = F.when(~m["flipped"], end - F.greatest(acc["hi"] + 1, x["pos"]) + 1).otherwise(F.least(acc["lo"], end + 1) - x["pos"])
            return F.struct(
                (acc["n"] + F.when(far, 0).otherwise(gain)).cast("long").alias("n"), F.when(far, acc["lo"]).otherwise(F.least(acc["lo"], x["pos"])).cast("long").alias("lo"),
                F.when(far, acc["hi"]).otherwise(F.greatest(acc["hi"], end)).cast("long").alias("hi"),
            )

        start = F.struct(F.lit(0).cast("long").alias("n"), low.cast("long").alias("lo"), high.cast("long").alias("hi"))
        return _bound(own, lambda xs: F.when(F.size(xs) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.reverse(xs), start, step, lambda acc: acc["n"])))

    return once(rows, "matches", F.transform("matches", support))


def bridges(store: DataFrame, *columns: str, least: int = MIN_SUPPORT, exclude_snps: bool = False) -> DataFrame:
    """One row per pair and signature: pair_id, ``columns`` of the pair, the bridge and its four support lengths (largest of the pair).

    Bridges join matches of one read. Bad reads (bad1, bad2) and duplicate pairs
    (dupe) are left out where the store says which they are.
    """
    rows = store.filter(~F.col("dupe")) if "dupe" in store.columns else store
    # a bridge takes two matches of one read
    rows = with_support(rows.filter(F.size("matches") > 1))
    good = (lambda m: ~F.when(m["read_2"], F.col("bad2")).otherwise(F.col("bad1"))) if "bad1" in store.columns else (lambda m: F.lit(True))
    high = {0: lambda a: ~a["flipped"], 1: lambda b: b["flipped"]}  # the side of the earlier and of the later match
    anchor = lambda m, k: F.when(high[k](m), m["low_support"]).otherwise(m["high_support"])
    place = lambda m, k: anchor_position(m["pos"], m["len"], high[k](m))

    def bridge(a: Column, b: Column) -> Column:
        # both base positions lie between the matches in the read; the mate lies on the far side of the later match only
        offset = (b["off"] - (a["off"] + a["len"] - 1)).cast("int")
        none = F.lit(0).cast("long")

        def turned(first: Column) -> Column:
            side = lambda x, y: F.when(first, x).otherwise(y)
            one = F.struct(
                side(a["chr"], b["chr"]).alias("chr1"), side(place(a, 0), place(b, 1)).alias("pos1"), side(high[0](a), high[1](b)).alias("high1"),
                side(b["chr"], a["chr"]).alias("chr2"), side(place(b, 1), place(a, 0)).alias("pos2"), side(high[1](b), high[0](a)).alias("high2"), offset.alias("offset"),
            )
            return F.struct(
                one.alias("s"), side(anchor(a, 0), anchor(b, 1)).alias("anchor1_len"), side(anchor(b, 1), anchor(a, 0)).alias("anchor2_len"),
                side(none, b["mate_support"]).alias("mate1_len"), side(b["mate_support"], none).alias("mate2_len"),
            )

        x, y = place(a, 0), place(b, 1)
        return _bound(F.when(a["chr"] != b["chr"], a["chr"] > b["chr"]).when(x != y, x < y).otherwise(high[0](a) | ~high[1](b)), turned)

    later = lambda a: F.filter("matches", lambda b: (b["read_2"] == a["read_2"]) & (b["ord"] > a["ord"]) & (anchor(b, 1) >= least))
    met = F.flatten(F.transform(F.filter("matches", lambda a: good(a) & (anchor(a, 0) >= least)), lambda a: F.transform(later(a), lambda b: bridge(a, b))))
    rows = once(rows, "matches", met).filter(F.size("matches") > 0).select("pair_id", *columns, F.col("matches").alias("ends"))
    # a signature counts once a pair, with the largest supports
    flat_ = lambda e: F.struct(*[e["s"][c].alias(c) for c in SIGNATURE], *[e[c].alias(c) for c in SUPPORT])
    most = lambda s, c: F.array_max(F.transform(F.filter("ends", lambda e: e["s"] == s), lambda e: e[c])).alias(c)
    merged = lambda ss: F.transform(ss, lambda s: F.struct(*[s[c].alias(c) for c in SIGNATURE], *[most(s, c) for c in SUPPORT]))
    distinct = _bound(F.array_distinct(F.transform("ends", lambda e: e["s"])), lambda ss: F.when(F.size(ss) == F.size("ends"), F.transform("ends", flat_)).otherwise(merged(ss)))
    out = rows.select("pair_id", *columns, F.inline(distinct))
    if exclude_snps:
        out = out.filter((F.col("chr1") != F.col("chr2")) | (invariant(F.col("high1"), F.col("pos1"), F.col("high2"), F.col("pos2"), F.col("offset")) != 0))
    return out


def build(reads: DataFrame, matches: DataFrame) -> DataFrame:
    """The store of sequenced pairs: matches by place, read lengths, and the bases that no match covers.

    ``reads``: pair_id, read_2, bases, bad. ``matches``: pair_id, read_2, off,
    len, chr, pos, flipped. Result: pair_id, len1, len2, bad1, bad2, matches and
    ``extra``: the uncovered bases of read 1, then of read 2, in read order.
    Reads without matches are kept whole in ``extra``.
    """
    at = F.struct("read_2", "off", "len", "chr", "pos", "flipped")
    m = matches.groupBy("pair_id").agg(F.sort_array(F.collect_list(at)).alias("found"))
    r = reads.groupBy("pair_id").agg(F.collect_list(F.struct("read_2", "bases", "bad")).alias("reads"))
    rows = r.join(m, "pair_id", "left").withColumn("found", F.coalesce("found", F.array().cast(m.schema["found"].dataType)))
    read = lambda two: F.get(F.filter("reads", lambda x: x["read_2"] == two), F.lit(0))
    rows = once(rows, "r1", F.coalesce(read(F.lit(False))["bases"], F.lit("")))
    rows = once(rows, "r2", F.coalesce(read(F.lit(True))["bases"], F.lit("")))
    bad = lambda two: F.coalesce(read(F.lit(two))["bad"], F.lit(False)).alias(f"bad{two + 1}")

    def left_over(two: bool) -> Column:
        seq, own = F.col(f"r{two + 1}"), F.filter("found", lambda x: x["read_2"] == F.lit(two))

        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(seq, acc["at"] + 1, F.greatest(x["off"] - acc["at"], F.lit(0)))
            return F.struct(F.greatest(acc["at"], x["off"] + x["len"]).cast("int").alias("at"), F.concat(acc["extra"], gap).alias("extra"))

        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("extra")), step, lambda acc: F.concat(acc["extra"], F.substring(seq, acc["at"] + 1, F.length(seq))))

    def place(x: Column, i: Column) -> Column:
        last = ~F.exists(F.slice("found", i + 2, F.size("found")), lambda y: y["read_2"] == x["read_2"])
        length = F.when(x["read_2"], F.length("r2")).otherwise(F.length("r1")).cast("int")
        return F.struct(i.cast("int").alias("ord"), *[x[c].alias(c) for c in ("chr", "pos", "len", "flipped", "read_2", "off")], length.alias("read_len"), last.alias("last_hit"), (x["off"] + x["len"] == length).alias("touches_end"))

    return rows.select(
        "pair_id", F.length("r1").cast("int").alias("len1"), F.length("r2").cast("int").alias("len2"), bad(False), bad(True), F.transform("found", place).alias("matches"), F.concat(left_over(False), left_over(True)).alias("extra")
    )


def merge(parts: list[DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """One store of several with distinct pair ids, with duplicates marked over all of them."""
    from functools import reduce

    return mark_duplicates(reduce(DataFrame.unionByName, parts), keys)


def index(store: DataFrame) -> DataFrame:
    """The matches in genome order: chr, pos, pair_id, ord. Ranges are sorted apart, and spill."""
    return flat(store).select("chr", "pos", "pair_id", "ord").repartitionByRange("chr", "pos", "pair_id", "ord").sortWithinPartitions("chr", "pos", "pair_id", "ord")


def reconstruct(store: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(pair_id, seq1, seq2): the reads of a built store, from the reference under their matches and the bases beside them.

    ``blocks``: the reference in blocks of ``size`` bases (chr, block, start,
    seq). A match meets the blocks that it spans by an equi-join.
    """
    from ..functions.dna import reverse_complement

    m = flat(store).select("pair_id", "ord", "chr", "pos", "len", "flipped")
    m = m.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((F.col("pos") + F.col("len") - 1) / size))))
    b = blocks.select("chr", F.col("block").cast("long").alias("block"), "start", "seq")
    begin, end = F.greatest(F.col("pos"), F.col("start")), F.least(F.col("pos") + F.col("len"), F.col("start") + size)
    met = m.join(b, ["chr", "block"]).select("pair_id", "ord", "flipped", "block", F.substring("seq", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    whole = met.groupBy("pair_id", "ord", "flipped").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("bases"))
    turned = F.when(F.col("flipped"), reverse_complement(F.col("bases"))).otherwise(F.col("bases"))
    found = whole.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", turned))).alias("bases"))
    rows = store.join(found, "pair_id", "left").withColumn("bases", F.coalesce("bases", F.create_map().cast("map<int,string>")))

    def read(two: bool, used: Column) -> Column:
        length = F.col("len2" if two else "len1")

        def step(acc: Column, x: Column) -> Column:
            gap = F.greatest(x["off"] - acc["at"], F.lit(0))
            # what an earlier match has already given is not given again
            own = F.substring(F.element_at("bases", x["ord"]), F.greatest(acc["at"] - x["off"], F.lit(0)) + 1, x["len"])
            return F.struct(F.greatest(acc["at"], x["off"] + x["len"]).cast("int").alias("at"), (acc["used"] + gap).cast("int").alias("used"), F.concat(acc["seq"], F.substring(F.col("extra"), acc["used"] + 1, gap), own).alias("seq"))

        start = F.struct(F.lit(0).alias("at"), used.cast("int").alias("used"), F.lit("").alias("seq"))
        tail = lambda acc: length - acc["at"]
        return F.aggregate(F.filter("matches", lambda x: x["read_2"] == F.lit(two)), start, step, lambda acc: F.struct(F.concat(acc["seq"], F.substring(F.col("extra"), acc["used"] + 1, tail(acc))).alias("seq"), (acc["used"] + tail(acc)).alias("used")))

    rows = once(rows, "one", read(False, F.lit(0)))
    rows = once(rows, "two", read(True, F.col("one.used")))
    return rows.select("pair_id", F.col("one.seq").alias("seq1"), F.col("two.seq").alias("seq2"))
