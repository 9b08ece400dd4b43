"""Removal of repeated passages by external induced suffix sorting.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Only suffixes that
share so many bytes with another matter, and Spark holds the tuples, so the sort is cut down in this way:

* Sampling. Every window of ``length`` bytes names one anchor: the smallest hash among its first positions. Equal
  windows name the same anchor, so equal windows meet at equal suffixes: those that start at their anchors. The window
  starts that name an anchor are a run just before it. An anchor whose first bytes occur once is dropped.
* Names. Whole windows at anchors are named by a 128-bit hash, and names are counted. Between two anchors whose windows
  repeat, less than a window apart, everything is covered: such runs are closed. Only anchors whose first bytes some open run
  shares are sorted.
* Induction. What is left are the edges of repeats. The suffixes at anchors are sorted by Spark, within groups that share their first
  bytes, and get their common-prefix lengths. From there suffixes to the left are induced, as in induced sorting: the suffix at d + 1 bytes
  before the anchor has the place that (byte before, place at d) gives it, and a common-prefix length one more than the least between
  the two places. A start whose common prefix with a neighbour reaches ``length`` repeats. A suffix leaves the sort as soon as
  it cannot reach that any more.

Spark's external sort and shuffle are the disk-backed queue of the tuples: a task holds one chunk of whole groups. A group too
large for a chunk is split in two: strings that share more to the right, and those that share more to the left (their
lengths add up to ``length``, so each pair is in one of them); the split ends at single windows, which are only counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.llm.common import distilled, materialise

LENGTH = 400
HEAD = 128  # bytes from an anchor on that lie in every window that names it
PASSAGE = {"length": 200, "head": 64, "least_words": 50}  # for keep_rest: fifty words of three letters and a space each are as long
GRAM = 8  # bytes that are hashed to choose anchors
CHUNK = 30_000  # suffixes that a task sorts at once
BLOCK = 1 << 16  # positions that anchors are chosen among at once
MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH_SCHEMA = "doc_id long, t1 long, t2 long, n_bytes long, sha256 string, pos array<int>, first array<int>, last array<int>, head array<long>, w1 array<long>, w2 array<long>"


def anchors_of(raw: bytes, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start) of each anchor; the starts of all windows of ``raw`` lie in one anchor's run each."""
    starts = len(raw) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    span = length - head + 1
    gram = min(GRAM, head)
    padded = raw + b"\0" * (GRAM - gram)
    grams = np.ndarray((len(raw) - gram + 1,), "<u8", padded + b"\0" * GRAM, strides=(1,))
    if gram < 8:
        grams = grams & np.uint64((1 << (8 * gram)) - 1)
    found = []
    for at in range(0, starts, BLOCK):
        end = min(at + BLOCK, starts)
        low = grams[at : end + span - 1] * MIX
        low ^= low >> np.uint64(29)
        low *= MIX
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(low), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: end - at], low[span - width : span - width + end - at])
        found.append((low[: end - at] & np.uint64(0xFFFFFFFF)).astype(np.int64) + at)
    named = np.concatenate(found)
    turn = np.flatnonzero(named[1:] != named[:-1]) + 1
    first = np.concatenate([[0], turn])
    return named[first], first, np.concatenate([turn - 1, [starts - 1]])


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two signed 64-bit columns."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sketch(docs: DataFrame, length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """A row (SKETCH_SCHEMA) per document (doc_id, text): its hash, size and anchors, with the hash of each anchor's head and of the window there (the head's twice if it is cut short)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                raw = (text or "").encode()
                pos, first, last = anchors_of(raw, length, head)
                where = pos.tolist()
                heads = np.fromiter((xxh3_64_intdigest(raw[p : p + head]) for p in where), np.uint64, len(where)).view(np.int64)
                w1, w2 = halves([xxh3_128_digest(raw[p : p + length] if p + length <= len(raw) else b"") for p in where])
                t1, t2 = halves([xxh3_128_digest(raw)])
                rows.append((doc_id, t1[0], t2[0], len(raw), hashlib.sha256(raw).hexdigest(), pos.astype(np.int32), first.astype(np.int32), last.astype(np.int32), heads, w1, w2))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SKETCH_SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SKETCH_SCHEMA)


ANCHOR = "array<struct<pos:int,first:int,last:int,head:long,whole:boolean,open:boolean,sorted:boolean>>"


def mark_anchors(sketches: DataFrame, length: int = LENGTH) -> DataFrame:
    """Anchors whose heads repeat: t1, t2 and a list of (pos, first, last, whole, open, sorted) by text.

    whole: the window at the anchor repeats. open: its run is not covered by such windows. sorted: some run with the same
    head is open, so this anchor takes part in the sort.
    """
    from xxhash import xxh3_128_digest

    e1, e2 = (int(x[0]) for x in halves([xxh3_128_digest(b"")]))
    each = sketches.select("t1", "t2", F.explode(F.arrays_zip("pos", "first", "last", "head", "w1", "w2")).alias("a")).select("t1", "t2", "a.*")
    heads = each.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    heads = materialise(heads, "heads")  # stored, so that the join is no part of the aggregation and a hot head can be split
    each = materialise(each.join(heads, "head"), "anchors", compression="zstd")
    cut = (F.col("w1") == e1) & (F.col("w2") == e2)
    whole = each.where(~cut).groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2", F.lit(True).alias("whole"))
    whole = materialise(whole, "whole")
    marked = each.join(whole, ["w1", "w2"], "left").select("t1", "t2", F.struct("pos", "first", "last", "head", F.coalesce("whole", F.lit(False)).alias("whole")).alias("a"))
    # copies of a text give the same set, which is united before the shuffle; a set is as large as its text
    marked = marked.groupBy("t1", "t2").agg(F.collect_set("a").alias("anchors"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = []
            for anchors in b["anchors"]:
                table = np.asarray([(a["pos"], a["first"], a["last"], a["whole"]) for a in anchors], np.int64).reshape(-1, 4)
                is_open = open_runs(table[:, 0], table[:, 1], table[:, 2], table[:, 3] > 0, length)
                lists.append([{**a, "open": bool(x), "sorted": False} for a, x in zip(anchors, is_open, strict=True)])
            yield b.assign(anchors=lists)

    opened = materialise(marked.mapInPandas(run, f"t1 long, t2 long, anchors {ANCHOR}"), "opened", compression="zstd")
    flat = opened.select("t1", "t2", F.explode("anchors").alias("a"))
    heads = flat.where("a.open").select(F.col("a.head").alias("head")).distinct().withColumn("sorted", F.lit(True))
    heads = materialise(heads, "open_heads")
    flat = flat.select("t1", "t2", "a", F.col("a.head").alias("head")).join(heads, "head", "left")
    flat = flat.select("t1", "t2", F.struct("a.pos", "a.first", "a.last", "a.whole", "a.open", F.coalesce("sorted", F.lit(False)).alias("sorted")).alias("a"))
    return flat.groupBy("t1", "t2").agg(F.collect_list("a").alias("anchors"))


def open_runs(pos: np.ndarray, first: np.ndarray, last: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Which anchors' runs are not covered by repeated windows at anchors around them, less than a window apart."""
    known = np.sort(pos[whole])
    if not len(known):
        return np.ones(len(pos), bool)
    left = np.searchsorted(known, first, side="right") - 1
    right = np.searchsorted(known, last, side="left")
    both = (left >= 0) & (right < len(known))
    gap = known[np.minimum(right, len(known) - 1)] - known[np.maximum(left, 0)]
    steps = np.diff(known, prepend=known[0])
    far = np.concatenate([[0], np.cumsum(steps > length)])  # breaks in the chain of known windows up to each
    chained = far[np.minimum(right, len(known) - 1) + 1] == far[np.maximum(left, 0) + 1]
    return ~(both & (chained | (gap <= length)))


EDGE_SCHEMA = "t1 long, t2 long, docs long, start int, open boolean, at int, few int, many int, f1 long, f2 long, piece binary"
SEEN = 1_000_000  # pieces that a task remembers


def edges(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of text around the sorted anchors of texts (t1, t2, docs, text, anchors), docs being the number of documents with this text.

    A piece begins at the run's first start and ends with its last window. ``at`` is the anchor's place in it, few and many are the
    least and most bytes from a start to the anchor; f1, f2 name the piece together with these. Every open run gives a row; a closed run
    only if the task has given none for an equal piece; the piece itself is given once for a task, else null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        given: set[bytes] = set()
        closed: set[bytes] = set()
        for b in batches:
            rows, digests = [], []
            for t1, t2, docs, text, anchors in zip(b["t1"], b["t2"], b["docs"], b["text"], b["anchors"], strict=True):
                raw = text.encode()
                for a in anchors:
                    if not a["sorted"]:
                        continue
                    p, f, e = a["pos"], a["first"], a["last"]
                    piece = raw[f : e + length]
                    digest = xxh3_128_digest(b"%d,%d," % (p - f, p - e) + piece)
                    if not a["open"]:
                        if digest in closed:
                            continue
                        closed.add(digest)
                    rows.append((t1, t2, docs, f, a["open"], p - f, p - e, p - f, 0, 0, None if digest in given else piece))
                    digests.append(digest)
                    given.add(digest)
                if len(given) > SEEN:
                    given.clear()
                    closed.clear()
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in EDGE_SCHEMA.split(", ")])
            if rows:
                out["f1"], out["f2"] = halves(digests)
            yield out

    return texts.mapInPandas(run, EDGE_SCHEMA)


def induce(buffer: np.ndarray, core: np.ndarray, size: np.ndarray, group: np.ndarray, few: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Least and most distance from a repeated start to the anchor, for each suffix; -1 if none repeats.

    buffer holds the pieces; core is where a suffix's anchor lies in it, size the number of bytes from there on. Suffixes stand
    in the order of (group, bytes from the anchor on). few and many bound the distances that are looked at.
    """
    m = len(core)
    least, most = np.full(m, -1), np.full(m, -1)
    if not m:
        return least, most
    lcp = np.zeros(m, np.int64)  # of each suffix with the one before it
    places = np.arange(length)
    for a in range(1, m, 4096):
        b = min(a + 4096, m)
        both = np.minimum(size[a:b], size[a - 1 : b - 1])
        last = len(buffer) - 1
        differ = buffer[np.minimum(core[a:b, None] + places, last)] != buffer[np.minimum(core[a - 1 : b - 1, None] + places, last)]
        differ |= places >= both[:, None]
        same = np.where(differ.any(1), differ.argmax(1), length)
        lcp[a:b] = np.where(group[a:b] == group[a - 1 : b - 1], same, 0)
    now = np.arange(m)
    for d in range(int(many.max()) + 1):
        if d:
            key = group[now] * 256 + buffer[core[now] - d]
            order = np.argsort(key, kind="stable")
            same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
            ends = np.stack([np.concatenate([[0], order[:-1] + 1]), order + 1], 1)  # between the two old places
            ends[~same] = (0, 1)
            between = np.minimum.reduceat(np.append(lcp, 0), ends.ravel())[::2]
            lcp, now = np.where(same, between + 1, 0), now[order]
        near = np.maximum(lcp, np.append(lcp[1:], 0))
        hit = now[(near >= length) & (few[now] <= d)]
        most[hit] = d
        least[hit[least[hit] < 0]] = d
        keep = np.flatnonzero((near + many[now] - d >= length) & (many[now] > d))
        if len(keep) < 1:
            break
        lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
        now = now[keep]
    return least, most


REPEAT_SCHEMA = "f1 long, f2 long, least int, most int"


def sort_groups(pieces: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """REPEAT_SCHEMA of pieces (g1, g2, f1, f2, at, few, many, piece), each group of which fits a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(b: pd.DataFrame) -> pd.DataFrame:
            sizes = b["piece"].str.len().to_numpy()
            starts = np.cumsum(sizes) - sizes
            core = starts + b["at"].to_numpy()
            g1, g2 = b["g1"].to_numpy(), b["g2"].to_numpy()
            group = np.concatenate([[0], np.cumsum((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))])
            buffer = np.frombuffer(b"".join(b["piece"]), np.uint8)
            least, most = induce(buffer, core, starts + sizes - core, group, b["few"].to_numpy(), b["many"].to_numpy(), length)
            found = most >= 0
            return pd.DataFrame({"f1": b["f1"][found], "f2": b["f2"][found], "least": least[found].astype(np.int32), "most": most[found].astype(np.int32)})

        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            if rows >= chunk:  # all but the last group are whole
                b = pd.concat(held, ignore_index=True)
                g1, g2 = b["g1"].to_numpy(), b["g2"].to_numpy()
                cut = int(np.flatnonzero((g1 != g1[-1]) | (g2 != g2[-1]))[-1]) + 1 if (g1 != g1[-1]).any() or (g2 != g2[-1]).any() else 0
                if cut:
                    yield one(b.iloc[:cut])
                held, rows = [b.iloc[cut:].reset_index(drop=True)], len(b) - cut
        if rows:
            yield one(pd.concat(held, ignore_index=True))

    ordered = pieces.select("g1", "g2", "f1", "f2", "at", "few", "many", "piece", F.expr("substring(piece, at + 1)").alias("suffix"))
    ordered = ordered.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "suffix").drop("suffix")
    return ordered.mapInPandas(run, REPEAT_SCHEMA)


GROUP_SCHEMA = "g1 long, g2 long, f1 long, f2 long, at int, few int, many int, copies long, l int, r int, piece binary"


def named_groups(pieces: DataFrame, split: bool, length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """Deal pieces to groups by the bytes that all their windows share: l to the left of the anchor and r from it on.

    At first that is the head alone. split: each group is replaced by its two halves, without the pieces that have no start there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for b in batches:
            rows, digests = [], []
            for f1, f2, at, few, many, copies, l, r, piece in zip(*(b[c] for c in ("f1", "f2", "at", "few", "many", "copies", "l", "r", "piece")), strict=True):  # noqa: E741
                width = length - l - r
                parts = [(l, r + width - width // 2, width // 2), (l + width // 2 + 1, r, width - width // 2 - 1)] if split else [(l, r, width)]
                for left, right, w in parts:
                    if w >= 0 and max(few, left) <= min(many, left + w) and at + right <= len(piece):
                        rows.append((0, 0, f1, f2, at, max(few, left), min(many, left + w), copies, left, right, piece))
                        digests.append(xxh3_128_digest(b"%d,%d," % (left, right) + piece[at - left : at + right]))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in GROUP_SCHEMA.split(", ")])
            if rows:
                out["g1"], out["g2"] = halves(digests)
            yield out

    return pieces.mapInPandas(run, GROUP_SCHEMA)


def repeats(pieces: DataFrame, length: int = LENGTH, head: int = HEAD, chunk: int = CHUNK) -> DataFrame:
    """REPEAT_SCHEMA of distinct pieces (f1, f2, at, few, many, copies, piece); a piece with copies repeats throughout."""
    whole = pieces.where("copies > 1").select("f1", "f2", F.col("few").alias("least"), F.col("many").alias("most"))
    found = whole
    waiting = named_groups(pieces.withColumn("l", F.lit(0)).withColumn("r", F.lit(head)), False, length, head)
    while True:
        sizes = materialise(waiting.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        dealt = materialise(waiting.join(sizes, ["g1", "g2"]), "groups", compression="zstd")
        found = found.union(sort_groups(dealt.where((F.col("n") <= chunk) & (F.col("l") + F.col("r") < length)), length, chunk))
        # single windows: everything in the group is equal
        found = found.union(dealt.where(F.col("l") + F.col("r") >= length).select("f1", "f2", F.col("l").alias("least"), F.col("l").alias("most")))
        large = dealt.where((F.col("n") > chunk) & (F.col("l") + F.col("r") < length))
        if large.isEmpty():
            break
        waiting = named_groups(large.drop("n"), True, length, head)
    return found.groupBy("f1", "f2").agg(F.min("least").alias("least"), F.max("most").alias("most"))


RESULT_SCHEMA = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def cut_out(texts: DataFrame, keep_text: bool, length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """RESULT_SCHEMA of texts (t1, t2, text, anchors, runs): runs are (start, at, least, most) of repeated starts; spans of fewer words than least_words stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t1, t2, text, anchors, runs in zip(b["t1"], b["t2"], b["text"], b["anchors"], b["runs"], strict=True):
                raw = text.encode()
                spans = [(a["pos"], a["pos"] + length) for a in anchors if a["whole"]]
                spans += [(r["start"] + r["at"] - r["most"], r["start"] + r["at"] - r["least"] + length) for r in (runs if runs is not None else ())]
                kept, at, removed, n = [], 0, 0, 0
                for s, e in merged(spans):
                    if least_words and len(raw[s:e].split()) < least_words:
                        continue
                    kept.append(raw[at:s])
                    n, removed, at = n + 1, removed + e - s, e
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((t1, t2, removed, n, hashlib.sha256(rest).hexdigest(), rest if keep_text and n else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT_SCHEMA.split(", ")])

    return texts.mapInPandas(run, RESULT_SCHEMA)


def remove_repeats(docs: DataFrame, keep_text: bool = False, length: int = LENGTH, head: int = HEAD, chunk: int = CHUNK, least_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and sha256 of the whole text, kept) of docs (doc_id, text).

    Null and empty texts have no bytes; texts shorter than ``length`` keep all. Equal texts of that length are removed whole. Repeated rows
    count as documents of their own. kept is null where nothing is removed or keep_text is false; it may
    break characters, as the unit is the byte. least_words: removed runs of fewer words stay.
    """
    sketches = materialise(sketch(docs, length, head), "sketches", compression="zstd")
    meta = sketches.select("doc_id", "t1", "t2", "n_bytes", "sha256")
    marked = distilled(docs.sparkSession, "marked", lambda: mark_anchors(sketches, length), compression="zstd")
    # one row stands for a text; the text itself is fetched for it alone
    stand_in = meta.groupBy("t1", "t2").agg(F.min("doc_id").alias("id"), F.count("*").alias("docs"), F.min("n_bytes").alias("n_bytes"))
    wanted = marked.join(stand_in, ["t1", "t2"]).select(F.col("id").alias("_id"), "t1", "t2", "docs", "n_bytes", "anchors")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.octet_length(docs["text"]) == F.col("n_bytes"))
    fetched = docs.join(wanted, same).select("t1", "t2", "docs", "text", "anchors")
    texts = materialise(only_own(fetched).dropDuplicates(["t1", "t2"]) if has_repeats(meta) else only_own(fetched), "texts", compression="zstd")
    pieces = materialise(edges(texts, length), "edges", compression="zstd")
    distinct = pieces.groupBy("f1", "f2").agg(F.sum("docs").alias("copies"), *(F.first(c, ignorenulls=True).alias(c) for c in ("at", "few", "many", "piece")))
    found = repeats(distinct, length, head, chunk)
    runs = pieces.where("open").select("t1", "t2", "start", "at", "f1", "f2").join(found, ["f1", "f2"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "at", "least", "most")).alias("runs"))
    cut = materialise(cut_out(texts.join(runs, ["t1", "t2"], "left"), keep_text, length, least_words), "cut", compression="zstd")
    return meta.join(cut, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "sha256", "kept",
    )


def with_rest(docs: DataFrame, length: int = LENGTH, head: int = HEAD, least_words: int = 0) -> DataFrame:
    """``doc`` (a row of docs as a struct), n_bytes, n_removed, n_spans, kept_sha256 and ``rest``: what stays of the text, null where nothing is removed.

    Bytes of a character that is cut in two are dropped from ``rest``, not from the digest.
    """

    @F.pandas_udf("string")
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda x: None if x is None else x.decode(errors="ignore"))

    def changes() -> DataFrame:
        found = remove_repeats(docs.select("doc_id", "text"), keep_text=True, length=length, head=head, least_words=least_words).where("n_spans > 0")
        return found.select(F.col("doc_id").alias("_id"), F.col("sha256").alias("_sha"), "n_removed", "n_spans", "kept_sha256", decoded("kept").alias("rest")).dropDuplicates(["_id", "_sha"])

    changed = distilled(docs.sparkSession, "changed", changes, compression="zstd")
    raw = F.coalesce("text", F.lit(""))
    doc = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("_own"), F.sha2(raw.cast("binary"), 256).alias("_own_sha"), F.octet_length(raw).cast("long").alias("n_bytes"))
    joined = doc.join(changed, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_sha") == F.col("_sha")), "left")
    none = F.lit(0).cast("long")
    return joined.select("doc", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_own_sha").alias("kept_sha256"), "rest")


def keep_rest(docs: DataFrame, length: int = PASSAGE["length"], head: int = PASSAGE["head"], least_words: int = PASSAGE["least_words"]) -> DataFrame:
    """The documents with all their columns, repeated passages cut out of ``text`` and ``n_chars`` set anew if there is such a column.

    A passage is a run of bytes covered by repeated strings of ``length`` bytes, with ``least_words`` words or more. No document goes, even if nothing is left of its text.
    """
    joined = with_rest(docs, length, head, least_words)
    new = {"text": F.coalesce("rest", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("rest").isNull(), F.col("doc.n_chars")).otherwise(F.length("rest").cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def has_repeats(meta: DataFrame) -> bool:
    """Whether any doc_id stands in several rows."""
    return not meta.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def only_own(fetched: DataFrame) -> DataFrame:
    """Rows whose text has the hash t1, t2: a repeated doc_id also meets the texts of its other rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for b in batches:
            t1, t2 = halves([xxh3_128_digest(x.encode()) for x in b["text"]] or [b"\0" * 16])
            yield b[(b["t1"].to_numpy() == t1[: len(b)]) & (b["t2"].to_numpy() == t2[: len(b)])] if len(b) else b

    return fetched.mapInPandas(run, fetched.schema)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, the digest of what stays, and what stays as text."""
    found = with_rest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("rest", "doc.text").alias("text"))
