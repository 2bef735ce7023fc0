"""Suffix-array dedup: remove every byte of a string of ``length`` bytes that
also starts anywhere else.

1. Equal texts collapse into one row that carries the number of its copies.
   The texts are written once, bucketed by their digest, and later passes meet
   them in their buckets without shuffling them again.
2. Each window of ``length`` bytes is anchored at its smallest gram hash
   (leftmost on ties), which depends on the window's bytes only.  So equal
   windows have equal anchors, at equal offsets.  Consecutive windows with one
   anchor form a segment; every window is in exactly one segment.
3. Only anchors that occur more than once matter.  Equal segments collapse into
   one, which carries the number of its places.  Where all segments of an
   anchor are equal, that number decides.
4. All other segments go to shards by their anchor.  A shard builds a suffix
   array by Larsson-Sadakane refinement: sort by the first bytes, then keep
   splitting the groups that are still tied by the rank of the suffix that
   starts as far ahead as the group is sorted.  Longest common prefixes come
   from Kasai's relation, computed at irreducible positions only.
   Neighbours with a common prefix of ``length`` bytes are equal windows.
5. An anchor with more text than a shard holds is split over several shards.
   Each gives the sorted digests of its distinct windows, dealt by digest
   range; a merging task finds equal windows of different shards by binary
   search of each shard's run in the others.

Memory is bounded by the shard and piece sizes, whatever the input.

Cases: null is the empty text; texts shorter than ``length`` lose nothing;
overlapping repeats inside one document count; equal texts under any ids are
repeats of each other; repeated rows give a row each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, table, text_of, written

LENGTH = 400
GRAM = 64
#: Bytes of segments in a shard; windows of a text that are anchored at once.
SHARD, PIECE = 1 << 20, 1 << 19
BASE = 0x9E3779B97F4A7C15
POSITION = 20


class Anchors:
    """Anchors of the windows of a text, piece by piece."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        n = PIECE + length
        ones = np.ones(n, np.uint64)
        ones[1:] = BASE
        self.power = np.multiply.accumulate(ones)
        ones[1:] = pow(BASE, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(ones)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each gram: a difference of prefix sums, mixed."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        n = len(data) - self.gram + 1
        h = (sums[self.gram :] - sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def segments(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first start, last start) of each segment."""
        found = []
        for at in range(0, len(text) - self.length + 1, PIECE):
            data = np.frombuffer(text, np.uint8, min(PIECE + self.length - 1, len(text) - at), at)
            h = self.hashes(data)
            key = h & np.uint64(~((1 << POSITION) - 1) & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64)
            n, w = len(h) - self.width + 1, self.width
            rows = -(-len(h) // w)
            grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
            grid[: len(key)] = key
            grid = grid.reshape(rows, w)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            best = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << POSITION) - 1)
            cuts = np.flatnonzero(best[1:] != best[:-1]) + 1
            first, last = np.r_[0, cuts], np.r_[cuts - 1, n - 1]
            found.append((h[best[first].astype(np.int64)].view(np.int64), first + at, last + at))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def suffix_array(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text with a separator after each segment, suffix array of it, each
    position's separator).  Separators sort below bytes, and by segment."""
    sizes = np.array([len(s) + 1 for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    n, end = len(text), np.repeat(ends, sizes)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):  # nine bits a byte; nothing behind the separator
        at = np.arange(n) + k
        alive &= at <= end
        key = key << 9 | np.where(alive, text[np.minimum(at, n - 1)], 0)
    key[ends] = np.arange(len(ends)) - len(ends) - 1  # separators differ
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    starts = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = starts[np.cumsum(head) - 1]  # a group's rank: where it begins
    depth = 7
    slots = np.flatnonzero(~(head & np.r_[head[1:], True]))  # places of tied suffixes
    while len(slots):
        members = order[slots]
        group, then = rank[members], rank[np.minimum(members + depth, end[members])]
        by = np.argsort(group * n + then, kind="stable")
        members, group, then = members[by], group[by], then[by]
        order[slots] = members
        head = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        starts = np.flatnonzero(head)
        rank[members] = slots[starts][np.cumsum(head) - 1]
        slots = slots[~(head & np.r_[head[1:], True])]
        depth *= 2
    return text, order, end


def common_prefixes(text: np.ndarray, order: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """For each place of the suffix array, the common prefix with the place
    before, at most ``most``.  By Kasai a suffix whose left neighbours agree in
    the byte before them has its predecessor's value less one; the others are
    compared byte by byte, side by side."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0) & (text[at - 1] == text[before - 1]) & (text[at - 1] > 0) & (np.r_[-2, before[:-1]] == before - 1)
    value = np.zeros(n, np.int64)
    todo = np.flatnonzero(~reducible & (before >= 0))
    room = np.minimum(end[todo] - todo, end[before[todo]] - before[todo])
    for step in range(int(room.max(initial=0))):
        same = (room > step) & (text[np.minimum(todo + step, n - 1)] == text[np.minimum(before[todo] + step, n - 1)])
        value[todo[~same]] = step
        todo, room = todo[same], room[same]
        if not len(todo):
            break
    value[todo] = room
    # what follows an irreducible position loses one for each step
    sums = np.where(reducible, -1, value + at)
    last = np.maximum.accumulate(np.where(reducible, -1, at))
    value = np.where(reducible, np.maximum(sums[np.maximum(last, 0)] - at, 0), value)
    return np.minimum(value, most)[order]


def equal_windows(segments: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct or repeated window: its segment, start, class and the
    class's weight; classes are numbered in suffix order."""
    text, order, end = suffix_array(segments)
    sizes = np.array([len(s) + 1 for s in segments])
    which = np.repeat(np.arange(len(segments)), sizes)
    prefix = common_prefixes(text, order, end, length)
    whole = end[order] - order >= length
    places = np.flatnonzero(whole)
    # between two whole windows stand only suffixes that share less
    joined = np.r_[False, (prefix[places[1:]] >= length) & (places[1:] == places[:-1] + 1)] if len(places) else np.zeros(0, bool)
    kind = np.cumsum(~joined) - 1
    starts = order[places]
    segment = which[starts]
    total = np.bincount(kind, weights=weights[segment]).astype(np.int64) if len(kind) else np.zeros(0, np.int64)
    return segment, starts - (np.cumsum(sizes) - sizes)[segment], kind, total[kind] if len(kind) else total


def runs(segment: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, first start, last start) of consecutive starts."""
    order = np.lexsort((start, segment))
    segment, start = segment[order], start[order]
    cuts = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (start[1:] != start[:-1] + 1), True]) if len(segment) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(segment[i]), int(start[i]), int(start[j - 1])


def _anchor(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, h, first, last, copies = [], [], [], [], []
                for tid, text, n in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    x, y, z = anchors.segments(text)
                    ids += [tid] * len(x)
                    copies += [n] * len(x)
                    h.append(x), first.append(y), last.append(z)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(np.concatenate(h)), pa.array(np.concatenate(first).astype(np.int64)), pa.array(np.concatenate(last).astype(np.int64)), pa.array(copies, pa.int64())], ["tid", "anchor", "first", "last", "copies"])

    return run


def _cut(length: int, with_bytes: bool):
    """Segments of the texts: digests, or bytes (each once a task, as far as it
    remembers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[dict] = []
                for tid, text, places in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for p in places:
                        data = text[p["first"] : p["last"] + length]
                        if not with_bytes:
                            out.append({"tid": tid, "anchor": p["anchor"], "first": p["first"], "last": p["last"], "copies": p["copies"], "segment": hashlib.blake2b(data, digest_size=16).digest()})
                        elif (key := p["anchor"].to_bytes(8, "big", signed=True) + p["segment"]) not in sent:
                            if len(sent) > 200_000:
                                sent.clear()
                            sent.add(key)
                            out.append({"shard": p["shard"], "split": p["split"], "anchor": p["anchor"], "segment": p["segment"], "weight": p["weight"], "data": data})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(CUT_BYTES if with_bytes else CUT))

    return run


CUT = [("tid", pa.binary()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("copies", pa.int64()), ("segment", pa.binary())]
CUT_BYTES = [("shard", pa.int64()), ("split", pa.bool_()), ("anchor", pa.int64()), ("segment", pa.binary()), ("weight", pa.int64()), ("data", pa.binary())]
FOUND = [("kind", pa.int32()), ("anchor", pa.int64()), ("segment", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("run", pa.binary())]
FOUND_SQL = "kind int, anchor long, segment binary, a long, b long, run binary"
#: What a shard says about its distinct windows to the merge.
RUN = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("segment", "<i4"), ("start", "<i4"), ("weight", "<i4")])


def _shard(length: int, ranges: int):
    """Rows (shard, split, anchor, segment, weight, data) sorted by shard to
    kind 0: starts a to b of a segment are repeated; for split anchors also
    kind 1: a run of window digests for range a, from shard b; kind 2: segment
    number a of shard b."""

    def solve(shard: int, split: bool, unique: dict[tuple, tuple]) -> Iterator[dict]:
        names = sorted(unique)
        weights = np.array([unique[x][0] for x in names], np.int64)
        data = [unique[x][1] for x in names]
        segment, start, kind, total = equal_windows(data, weights, length)
        again = total > 1
        for s, i, j in runs(segment[again], start[again]):
            yield {"kind": 0, "anchor": names[s][0], "segment": names[s][1], "a": i, "b": j}
        if not split or not len(kind):
            return
        for s, (anchor, name) in enumerate(names):
            yield {"kind": 2, "anchor": anchor, "segment": name, "a": s, "b": shard}
        heads = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        digests = np.frombuffer(b"".join(hashlib.blake2b(data[s][i : i + length], digest_size=16, key=names[s][0].to_bytes(8, "big", signed=True)).digest() for s, i in zip(segment[heads].tolist(), start[heads].tolist(), strict=True)), "<u8").reshape(-1, 2)
        out = np.zeros(len(heads), RUN)
        out["hi"], out["lo"] = digests[:, 0], digests[:, 1]
        out["segment"], out["start"], out["weight"] = segment[heads], start[heads], np.minimum(total[heads], 2)
        out.sort(order=["hi", "lo"])
        dealt = (out["hi"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(dealt, np.arange(ranges + 1, dtype=np.uint64))
        for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                yield {"kind": 1, "a": r, "b": shard, "run": out[i:j].tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, split, unique = None, False, {}

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(solve(now, split, unique)) if unique else []
            for at in range(0, len(found), 5000):
                yield pa.RecordBatch.from_pylist(found[at : at + 5000], schema=pa.schema(FOUND))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for shard, one, anchor, segment, weight, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if shard != now:
                        yield from flush()
                        now, split, unique = shard, one, {}
                    unique.setdefault((anchor, segment), (weight, data))  # every task sent its own copy
        yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, shard, run), sorted by range: windows of weight 1 that some
    other shard has too, as (b: shard, a: segment number, start)."""

    def solve(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        lists = [(shard, np.frombuffer(raw, RUN)) for shard, raw in parts]
        hi = np.sort(np.concatenate([x["hi"] for _, x in lists]))
        for shard, x in lists:
            # binary search in all runs: first where the high half stands twice
            i, j = np.searchsorted(hi, x["hi"], "left"), np.searchsorted(hi, x["hi"], "right")
            maybe = np.flatnonzero((j - i > 1) & (x["weight"] < 2))
            met = np.zeros(len(maybe), bool)
            for other, y in lists:
                if other == shard or not len(maybe):
                    continue
                at = np.searchsorted(y["hi"], x["hi"][maybe], "left")
                to = np.searchsorted(y["hi"], x["hi"][maybe], "right")
                for step in range(int((to - at).max(initial=0))):
                    k = np.minimum(at + step, len(y) - 1)
                    met |= (at + step < to) & (y["lo"][k] == x["lo"][maybe])
            hit = x[maybe[met]]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), shard, np.int64)), pa.array(hit["segment"].astype(np.int64)), pa.array(hit["start"].astype(np.int64))], ["shard", "number", "start"])

    now, parts = None, []
    for batch in batches:
        for r, shard, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != now:
                yield from solve(parts) if parts else ()
                now, parts = r, []
            parts.append((shard, raw))
    if parts:
        yield from solve(parts)


def _remove(length: int):
    """Rows (tid, text, intervals of starts) to counts, spans and kept bytes."""
    kinds = [("tid", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for tid, text, found in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    spans: list[dict] = []
                    for first, last in sorted((x["first"], x["last"]) for x in found or ()):
                        if spans and first <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], last + length)
                        else:
                            spans.append({"begin": first, "end": last + length})
                    edges = [0, *(x for s in spans for x in (s["begin"], s["end"])), len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                    out.append({"tid": tid, "n_bytes": len(text), "n_removed": len(text) - len(kept), "spans": spans, "kept": kept})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, result: tuple = ("n_bytes", "n_removed", "spans", "kept")) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of begin, end in bytes: what is
    removed), kept (binary: the rest).

    result: columns over these to return in their place; they are computed once
    a distinct text, before the rows of its copies meet it."""
    if not 0 < gram <= length:
        raise ValueError("a gram is at most as long as a window")
    digest = F.unhex(F.sha2("text", 256))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    ids = rows.select("doc_id", digest.alias("tid"))
    texts = bucketed(rows.groupBy(digest.alias("tid")).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies")), "tid", "sufdedup_texts")
    anchored = written(texts.mapInArrow(_anchor(length, gram), "tid binary, anchor long, first long, last long, copies long"), "sufdedup-anchors")
    often = written(anchored.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "sufdedup-often")

    def cut(places: DataFrame, columns: list[str], with_bytes: bool, schema: str) -> DataFrame:
        lists = places.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("places"))
        return texts.select("tid", "text").join(lists.hint("merge"), "tid").select("tid", "text", "places").mapInArrow(_cut(length, with_bytes), schema)

    places = cut(anchored.join(often, "anchor"), ["anchor", "first", "last", "copies"], False, "tid binary, anchor long, first long, last long, copies long, segment binary")
    places = written(places, "sufdedup-places")
    weights = places.groupBy("anchor", "segment").agg(F.sum("copies").alias("weight"), F.max(F.col("last") - F.col("first") + length + 1).alias("size"))
    weights = written(weights, "sufdedup-weights")
    groups = written(weights.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("bytes")), "sufdedup-groups")
    total = groups.where("kinds > 1").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-2 * total // shard))
    # an anchor with over half a shard of text gets shards of its own
    split = F.col("bytes") * 2 > shard
    spread = F.ceil(F.col("bytes") * 2 / shard).cast("long")
    own = F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("segment"), spread)), F.lit(1 << 62)) + F.lit(1 << 62)
    number = F.when(split, own).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sorted_out = weights.join(groups, "anchor").select("anchor", "segment", "weight", "kinds", number.alias("shard"), split.alias("split"))
    sorted_out = written(sorted_out, "sufdedup-shards")
    known = written(places.join(sorted_out, ["anchor", "segment"]), "sufdedup-known")
    mixed = known.where("kinds > 1")
    data = cut(mixed, ["anchor", "first", "last", "segment", "weight", "shard", "split"], True, "shard long, split boolean, anchor long, segment binary, weight long, data binary")
    ranges = max(1, min(4096, total // (8 * shard)))
    found = written(data.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard(length, ranges), FOUND_SQL), "sufdedup-found")
    runs_of = found.where("kind = 1").select(F.col("a").alias("range"), F.col("b").alias("shard"), "run")
    met = runs_of.repartition("range").sortWithinPartitions("range").mapInArrow(_merge, "shard long, number long, start long")
    named = found.where("kind = 2").select(F.col("b").alias("shard"), F.col("a").alias("number"), "anchor", "segment")
    crossed = met.join(named, ["shard", "number"]).select("anchor", "segment", F.col("start").alias("a"), F.col("start").alias("b"))
    repeated = written(found.where("kind = 0").select("anchor", "segment", "a", "b").unionByName(crossed), "sufdedup-repeated")
    starts = mixed.select("tid", "first", "anchor", "segment").join(repeated, ["anchor", "segment"]).select("tid", (F.col("first") + F.col("a")).alias("begin"), (F.col("first") + F.col("b")).alias("end"))
    starts = starts.unionByName(known.where("kinds = 1").select("tid", F.col("first").alias("begin"), F.col("last").alias("end")))
    lists = starts.groupBy("tid").agg(F.collect_list(F.struct(F.col("begin").alias("first"), F.col("end").alias("last"))).alias("found"))
    kept = texts.select("tid", "text").join(lists.hint("merge"), "tid", "left").select("tid", "text", "found")
    kept = kept.mapInArrow(_remove(length), "tid binary, n_bytes long, n_removed long, spans array<struct<begin:bigint,end:bigint>>, kept binary")
    kept = kept.select("tid", *result)
    return ids.join(kept, "tid").select("doc_id", *kept.columns[1:])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes: its length in
    bytes, how many are removed, in how many runs, and the digest of the rest."""
    n_spans, digest = F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    more = ((F.col("n_removed") > 0).alias("has_repeat"), F.length("kept").cast("long").alias("kept_bytes"))
    return remove_repeats(table(spark, sf_dir, "documents"), result=("n_bytes", "n_removed", n_spans, digest, *more))
