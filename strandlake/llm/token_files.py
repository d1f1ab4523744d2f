"""Token counts from flat, unindexed token files.

A token file holds the ids of many documents, one end-of-document id after each,
as little-endian unsigned integers and nothing else: no index, no lengths. To
count the tokens of each document

1. files are cut into blocks of equal size, whatever documents they cut through;
2. each block is read by itself and searched for the end-of-document id with one
   vectorised comparison; it reports where it found one;
3. a prefix scan over the block summaries of a file gives every block the number
   of documents before it and the end of the last one, which stitches documents
   that span blocks.

Blocks are independent tasks of bounded memory; a lost one is read again. A
file that ends without the end-of-document id has one open document at its end.

:func:`write` makes such files from a table, with a manifest of which document
went where. Every task writes its own file under a temporary name and renames
it, so a repeated task leaves no half-written file.

Edge cases: null and empty texts have 0 tokens; empty files have no document;
text that spells a special token is ordinary text; runs of millions of equal
characters, white space too, are encoded whole; repeated rows are counted
each; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, shared_dir, written

#: Fixed value: the pattern by which the rank vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS, EOD = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: The characters that the pattern counts as white space; runs from this length on are cut out.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
BLOCK_TOKENS = 1 << 22
FLUSH_TOKENS = 1 << 20


def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encode(coder, text: str | None) -> list[int]:
    """Token ids of a whole text.

    The pattern looks ahead over white space, which its engine can't do over a
    very long run. Such a run ends a piece where it starts, and is one piece up
    to its last character, which belongs to what follows: so the text is cut
    there, and the ids are those of the uncut text.
    """
    text = text if isinstance(text, str) else ""
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += coder.encode_ordinary(text[at : run.start()])
        out += coder._encode_single_piece(text[run.start() : end].encode("utf-8"))
        at = end
    return out + coder.encode_ordinary(text[at:]) if at else coder.encode_ordinary(text)


def _filesystem(uri: str):
    """(file system, path) of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, folder: str, ranks_path: str = RANKS, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """Tokenise every whole text into flat files below ``folder``; the manifest: file, ordinal, doc_id."""
    with open(ranks_path, "rb") as f:  # on the driver; tasks get the vocabulary with the job
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, fs, root = None, *_filesystem(folder)
        name = f"tokens-{uuid.uuid4().hex}.bin"
        sink, ordinal, held, n = None, 0, [], 0
        for b in batches:
            coder = coder or _encoder(shared.value)
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/_{name}.tmp")
            for text in b["text"]:
                ids = encode(coder, text)
                held.append(np.array([*ids, eod], dtype))
                n += len(ids) + 1
                if n >= FLUSH_TOKENS:
                    sink.write(np.concatenate(held).tobytes())
                    held, n = [], 0
            yield pd.DataFrame({"file": name, "ordinal": np.arange(ordinal, ordinal + len(b)), "doc_id": b["doc_id"].array})
            ordinal += len(b)
        if sink is not None:
            if held:
                sink.write(np.concatenate(held).tobytes())
            sink.close()
            fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")

    return written(only(docs, "doc_id", "text").mapInPandas(run, "file string, ordinal long, doc_id long"), "token-manifest")


def scan(spark: SparkSession, folder: str, eod: int = EOD, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, start, n_tokens, closed of every document in the token files below ``folder``."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder).select("path", (F.col("length") / width).cast("long").alias("size"))
    blocks = files.filter("size > 0").select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_tokens).cast("long"))).alias("block", "at"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, block, at in b.itertuples(index=False):
                fs, p = _filesystem(path)
                with fs.open_input_file(p) as f:
                    ids = np.frombuffer(f.read_at(min(block_tokens, size - at) * width, at * width), dtype)
                ends = np.flatnonzero(ids == eod) + at
                yield pd.DataFrame({"path": [path], "size": [size], "block": [block], "ends": [ends]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(blocks.repartition(n, "path", "block").mapInPandas(search, "path string, size long, block int, ends array<long>"), "token-ends")
    # the prefix scan reads one small row per block
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "size", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = summary.withColumns({
        "first": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")),
    }).select("path", "block", "first", "open")
    whole = found.join(carried, ["path", "block"]).select("path", "first", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.coalesce(F.get("ends", F.col("k") - 1), F.col("open")) + 1
    closed = whole.select("path", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = summary.groupBy("path").agg(F.max("size").alias("size"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start")).filter("start < size")
    rest = tail.select("path", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest).withColumn("file", F.element_at(F.split("path", "/"), -1)).select("file", "ordinal", "start", "n_tokens", "closed")


def count_tokens(docs: DataFrame, ranks_path: str = RANKS, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens of every row: written to flat token files, counted by the separator scan."""
    folder = shared_dir(docs.sparkSession, "token-files")
    manifest = write(docs, folder, ranks_path, eod)
    if not manifest.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_tokens long")
    return manifest.join(scan(docs.sparkSession, folder, eod, block_tokens=block_tokens), ["file", "ordinal"]).select("doc_id", "n_tokens")
