"""Best-two-fit packing of token sequences.

Texts are tokenized in the tasks and cut into pieces of at most one sequence. Token lengths are whole
numbers up to the sequence length, so the packing itself needs only the histogram of lengths, which has
a fixed size: a bin is filled greedily with the longest pieces that fit, then its smallest piece is
replaced by the two unpacked lengths that fill the widened gap most tightly, and the same bin is used for
as many copies as the counts allow. Pieces then find their place by their rank among the pieces of their
length, which is counted per (length, salt) cell, so a length that a third of all pieces share is dealt out.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.llm.common import materialise

SEQUENCE = 4096
END_ID = 1
CACHE_WORDS = 1_000_000  # of a Python worker; once there are so many, further words are encoded where they stand
LEAST_SALTS, ROWS_A_SALT = 16, 1_000_000
#: Texts of other characters go through the tokenizer whole: beyond these, its Unicode tables and Python's may differ.
PLAIN = re.compile("[\t\n\r -~\xa0-įĲ-ɏ‐-‧]*")
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_of_character() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins across it, so the ids of a text are those of its
    white-space-separated words, which are kept in a bounded cache. New words are merged by byte ranks, which is many times faster: the
    end-of-word mark becomes the byte 0, which no word holds, and a merge ranks as the id that it makes. A
    vocabulary whose ids are not in the order of its merges, and any text that is not plain, goes through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        model = json.loads(Path(path).read_text())["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        self.ranked = made == sorted(made) and len(set(made)) == len(made) and made[0] == 512
        byte, ranks, ends = byte_of_character(), {}, np.zeros(len(vocab), bool)
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            if i < made[0] + len(made):
                ranks[bytes(byte[c] for c in body) + b"\0" * (body != token)] = i
                ends[i] = body != token
        self.ends = ends
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        if not self.ranked:
            return {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)}
        pieces = [(w,) if w.isalpha() else self.pieces.findall(w) for w in words]
        ids = self.ranks.encode_to_numpy("\0".join(itertools.chain.from_iterable(pieces)) + "\0", allowed_special=set(), disallowed_special=())
        last = np.flatnonzero(self.ends[ids])[np.cumsum([len(p) for p in pieces]) - 1]
        raw, cuts = ids.astype("<u4").tobytes(), [0, *(4 * (last + 1)).tolist()]
        return {w: raw[a:b] for w, (a, b) in zip(words, itertools.pairwise(cuts), strict=True)}

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, cache = text.lower().split(), self.cache
        new = list({w for w in words if w not in cache})
        if new:
            found = self.encode_words(new)
            if len(cache) + len(found) > CACHE_WORDS:
                return b"".join(cache[w] if w in cache else found[w] for w in words)
            cache.update(found)
        return b"".join(map(cache.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def public_path() -> str:
    """Where the public word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces (PIECE_SCHEMA) of docs (doc_id, text): ids, then END_ID, cut every ``sequence`` ids. A null text is empty. path: of the tokenizer's file, on every executor."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one tokenizer for a Python worker, so that later tasks find the words of earlier ones
        name = path or public_path()
        if name not in _tokenizers:
            _tokenizers[name] = WordTokenizer(name)
        own = _tokenizers[name]
        for b in batches:
            ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                raw = own.encode(text or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * sequence)):
                    part = raw[at : at + 4 * sequence]
                    ids.append(doc_id)
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "piece": np.asarray(pieces, np.int32), "start": np.asarray(starts, np.int64), "length": np.asarray(lengths, np.int64), "ids_crc32": np.asarray(sums, np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE_SCHEMA)


def best_two_fit(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Bins as (lengths in place order, number of such bins); every length is used as often as counts says."""
    left = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        have = np.flatnonzero(left)
        used, gap, spare = [], sequence, left.copy()
        while len(fit := have[have <= gap]):  # the longest that fit, as often as they fit
            x = int(fit[-1])
            n = int(min(spare[x], gap // x))
            used += [x] * n
            gap -= n * x
            spare[x] -= n
            have = have[: len(fit)] if spare[x] else have[: len(fit) - 1]
        if gap and len(used) > 1 and (pair := tightest_pair(spare, gap + used[-1], used[-1])):
            used[-1:] = pair
        lengths, often = np.unique(used, return_counts=True)
        times = int((left[lengths] // often).min())
        left[lengths] -= times * often
        bins.append((used, times))
    return bins


def tightest_pair(spare: np.ndarray, room: int, beat: int) -> list[int] | None:
    """The two spare lengths with the largest sum up to ``room``, if it is over ``beat``."""
    have = np.flatnonzero(spare)
    have = have[have < room]
    if not len(have):
        return None
    at = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1  # the other is not longer
    alone = (at >= 0) & (have[np.maximum(at, 0)] == have) & (spare[have] < 2)
    at = np.where(alone, at - 1, at)
    sums = np.where(at >= 0, have + have[np.maximum(at, 0)], -1)
    best = int(sums.argmax())
    return [int(have[best]), int(have[at[best]])] if sums[best] > beat else None


def placements(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset): ranks from there on go to successive sequences."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for used, times in bins:
        offset = 0
        for x in used:
            rows.setdefault(x, []).append((rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.asarray(r, np.int64) for x, r in rows.items()}


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (PIECE_SCHEMA, read three times: pass a stored table).

    To the driver comes the histogram, at most ``sequence`` rows; the plan that it sends out has a few rows per
    length. Equal pieces of repeated documents are packed each. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    n = pieces.agg(F.greatest(F.lit(LEAST_SALTS), F.ceil(F.count("*") / ROWS_A_SALT)).cast("long").alias("salts"))
    dealt = pieces.crossJoin(F.broadcast(n)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")  # one row: a global aggregate
    cells = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before)
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(placements(best_two_fit(counts, sequence)))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("rn", rank).join(cells.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("rn") - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequences, offsets = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for length, at in b.groupby("length").indices.items():
                rows, ranks = plan.value[length], b["rank"].to_numpy()[at]
                own = rows[np.searchsorted(rows[:, 0], ranks, side="right") - 1]
                sequences[at], offsets[at] = own[:, 1] + ranks - own[:, 0], own[:, 2]
            yield b.drop(columns="rank").assign(sequence_id=sequences, offset=offsets)

    return ranked.mapInPandas(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(materialise(tokenize(docs), "pieces"))
