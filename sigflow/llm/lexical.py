"""Ranked lexical search by Block-Max MaxScore over index segments.

``build_index`` turns bounded slices of the documents into segments, one row
each: a dictionary of all terms and, for every term, its postings in blocks of
``BLOCK`` documents, compressed. A block keeps its last document and its
competitive (occurrences, document length) pairs: those that no other pair of
the block beats in both. They give the block's exact maximum whatever the
corpus statistics are, so the index does not depend on them or on the queries.

``search`` deals the queries in blocks to the tasks that read the segments. In
a segment a query's lists are put in order of their maxima; the first lists
whose maxima together stay below the k-th best score so far are non-essential:
only documents of the other, essential lists are candidates. On non-essential
lists a block's maximum rejects a candidate before the block is decompressed.
Every task keeps a heap of k documents a query over all its segments, and the
heaps are merged at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.common import materialise, text_of
from sigflow.llm.textbatch import distinct_spans, lower_bytes, padded, ragged, slices, span_hashes, words_of

BLOCK = 128                  # postings in a block
SEGMENT_BYTES = 2 << 20      # text in a segment; a longer text is a segment of its own
GROUP_BYTES = 4 << 20        # segments that a task reads or writes at once, about
QUERY_TERMS = 1 << 18        # (query, term) rows dealt to the tasks at once, about

# the bytes between terms: all ASCII but 0-9, A-Z and a-z
GAP = np.zeros(256, bool)
GAP[:0x80] = True
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

SEGMENT = ("sizes binary, hashes binary, terms binary, ends binary, lists binary, held binary, counts binary, "
           "lasts binary, places binary, widths binary, edges binary, often binary, long binary, data binary")


# ------------------------------------------------------------------ segments
def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


def _spread(data: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Write ``values`` little-endian in ``width`` bytes each at ``at``."""
    for b in range(4):
        on = width > b
        data[at[on] + b] = (values[on] >> (8 * b)) & 255


def _gather(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for b in range(4):
        on = np.flatnonzero(width > b)
        if not len(on):
            break
        out[on] |= data[at[on] + b].astype(np.int64) << (8 * b)
    return out


def compress(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, size: np.ndarray, n_terms: int) -> dict:
    """Postings in order of (term, doc) as blocks. ``size`` is the documents'
    number of terms."""
    held = np.bincount(term, minlength=n_terms)
    blocks = -(-held // BLOCK)
    lists = np.concatenate([[0], np.cumsum(blocks)])                   # first block of every list
    within = ragged(np.zeros(n_terms, np.int64), blocks)
    counts = np.minimum(np.repeat(held, blocks) - within * BLOCK, BLOCK)
    begin = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    lasts = doc[begin + counts - 1]
    before = np.where(within > 0, np.concatenate([[-1], lasts[:-1]]), -1)
    step = np.diff(doc, prepend=0) - 1
    step[begin] = doc[begin] - before - 1
    wide = [_widths(np.maximum.reduceat(v, begin)) if len(begin) else np.zeros(0, np.uint8) for v in (step, tf)]
    room = counts * (wide[0].astype(np.int64) + wide[1])
    places = np.cumsum(room) - room
    data = np.zeros(int(room.sum()), np.uint8)
    inner = np.arange(len(doc)) - begin[of]
    _spread(data, places[of] + inner * wide[0][of], step, wide[0][of])
    _spread(data, places[of] + counts[of] * wide[0][of] + inner * wide[1][of], tf, wide[1][of])
    # competitive pairs: by falling occurrences, those shorter than all before
    length = size[doc]
    order = np.lexsort((length, -tf, of))
    ranked = length[order] - of * (int(size.max(initial=0)) + 1)       # blocks stay apart in a running minimum
    least = np.minimum.accumulate(ranked) if len(ranked) else ranked
    best = np.ones(len(order), bool)
    best[1:] = ranked[1:] < least[:-1]
    pairs = order[best]
    edges = np.searchsorted(of[pairs], np.arange(len(counts) + 1))
    return {"lists": lists.astype("<u4"), "held": held.astype("<u4"), "counts": counts.astype(np.uint8),
            "lasts": lasts.astype("<u4"), "places": places.astype("<u8"), "widths": (wide[0] | wide[1] << 4).astype(np.uint8),
            "edges": edges.astype("<u4"), "often": tf[pairs].astype("<u4"), "long": length[pairs].astype("<u4"), "data": data}


def segment(data: np.ndarray, offsets: np.ndarray) -> dict:
    """The columns of ``SEGMENT`` for some texts."""
    data = lower_bytes(data)
    starts, lens, of = words_of(data, offsets, GAP)
    size = np.diff(of)
    first, code = distinct_spans(data, starts, lens)
    hashes = span_hashes(padded(data), starts[first], lens[first])
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = max(len(size), 1)
    key = np.sort(rank[code] * n + np.repeat(np.arange(len(size)), size))
    lead = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(lead, len(key)))
    lead = key[lead]
    at, width = starts[first[order]], lens[first[order]]
    return {"sizes": size.astype("<u4"), "hashes": hashes[order].astype("<u8"), "terms": data[ragged(at, width)],
            "ends": np.cumsum(width).astype("<u8"), **compress(lead // n, lead % n, tf, size, len(order))}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all terms of all whole texts, written to the shared folder:
    a row (segment) for every slice of bounded size (a longer text is a
    segment of its own) with the ids, the number of documents that have a term
    (n_docs), of terms (n_terms) and the columns of ``SEGMENT``. NULL texts
    have no terms; repeated rows are documents of their own."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, data, offsets in slices(batches, limit=SEGMENT_BYTES):
            made = segment(data, offsets)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([int((made["sizes"] > 0).sum())]), pa.array([int(made["sizes"].sum(dtype=np.int64))]),
                 *[pa.array([v.tobytes()], pa.binary()) for v in made.values()]],
                ["ids", "n_docs", "n_terms", *made])

    names = [c.split()[0] for c in SEGMENT.split(", ")]
    schema = f"ids array<{kind}>, n_docs long, n_terms long, {SEGMENT}"
    return materialise(rows.mapInArrow(run, schema).select("ids", "n_docs", "n_terms", *names), "segments", GROUP_BYTES)


# ------------------------------------------------------------------ one segment's search
class Lists:
    """The postings of one segment, decompressed block by block."""

    def __init__(self, row: dict):
        kinds = {"counts": np.uint8, "widths": np.uint8, "data": np.uint8, "terms": np.uint8,
                 "hashes": "<u8", "ends": "<u8", "places": "<u8"}
        for name, value in row.items():
            setattr(self, name, np.frombuffer(value, kinds.get(name, "<u4")))

    def find(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The place of every term in the dictionary, or -1. Bytes decide."""
        at = np.searchsorted(self.hashes, hashes)
        out, n = np.full(len(terms), -1, np.int64), len(self.hashes)
        raw = self.terms.tobytes()
        for i in np.flatnonzero(at < n):
            j = int(at[i])
            while j < n and self.hashes[j] == hashes[i]:
                if raw[int(self.ends[j - 1]) if j else 0:int(self.ends[j])] == terms[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def postings(self, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, occurrences, how many) of some blocks; ``first`` marks
        those that begin their list."""
        count = self.counts[blocks].astype(np.int64)
        place, width = self.places[blocks].astype(np.int64), self.widths[blocks]
        near, far = (width & 15).astype(np.int64), (width >> 4).astype(np.int64)
        inner = ragged(np.zeros(len(blocks), np.int64), count)
        of = np.repeat(np.arange(len(blocks)), count)
        doc = _gather(self.data, place[of] + inner * near[of], near[of]) + 1
        tf = _gather(self.data, place[of] + count[of] * near[of] + inner * far[of], far[of])
        total = np.cumsum(doc)
        begin = np.cumsum(count) - count
        base = np.where(first, -1, self.lasts[np.maximum(blocks - 1, 0)].astype(np.int64))
        gone = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0)
        return total + (base - gone)[of], tf, count


class Scorer:
    """The contributions of the ranking: floor(1000 ln((2N+2)/(2df+1))) times
    (scale tf) div (1000 tf + 20 m), all but the logarithm in whole numbers."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))

    def part(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * size * self.docs) // max(self.terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def best_of_segment(lists: Lists, size: np.ndarray, found: list[tuple[int, int, np.ndarray]], scorer: Scorer,
                    k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the segment's documents that may be among the k
    best: all whose score is at least ``floor`` and the segment's own k-th.
    ``found``: (weight, first block, block maxima without weight) by term."""
    lists_at = sorted(((w * int(m.max()), w, a, m) for w, a, m in found if w > 0), key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in lists_at])
    cut = int(np.searchsorted(reach, floor, "left"))        # lists 0 to cut-1 together stay below the floor
    acc = np.zeros(len(size), np.int64)
    essential = lists_at[cut:]
    if not essential:
        return np.zeros(0, np.int64), acc[:0]
    blocks = np.concatenate([np.arange(a, a + len(m)) for _, _, a, m in essential])
    first = np.concatenate([np.arange(len(m)) == 0 for _, _, _, m in essential])
    doc, tf, count = lists.postings(blocks, first)
    weight = np.repeat(np.concatenate([np.full(len(m), w) for _, w, _, m in essential]), count)
    np.add.at(acc, doc, weight * scorer.part(tf, size[doc]))
    cand = np.flatnonzero(acc)
    for i in range(cut - 1, -1, -1):
        if len(cand) >= k:
            floor = max(floor, int(np.partition(acc[cand], len(cand) - k)[len(cand) - k]))
        cand = cand[acc[cand] + reach[i] >= floor]
        if not len(cand):
            break
        _, w, a, most = lists_at[i]
        at = np.searchsorted(lists.lasts[a:a + len(most)], cand)
        there = at < len(most)
        may = np.where(there, w * most[np.minimum(at, len(most) - 1)], 0)
        good = acc[cand] + may + (reach[i - 1] if i else 0) >= floor      # else rejected, its block unread
        cand, at = cand[good], at[good & there]
        if len(at):
            need = np.unique(at)
            doc, tf, _ = lists.postings(a + need, need == 0)
            on = np.isin(doc, cand, assume_unique=True)
            acc[doc[on]] += w * scorer.part(tf[on], size[doc[on]])
    cand = cand[acc[cand] >= max(floor, 1)]
    return cand, acc[cand]


def _order(item):
    score, doc = item
    return -score, doc is None, doc if doc is not None else 0


# ------------------------------------------------------------------ search
def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, term, hash): the distinct terms of every query row."""
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"),
                          text_of(text_col).alias("text"))

    def run(batches):
        for batch, data, offsets in slices(batches):
            data = lower_bytes(data)
            starts, lens, of = words_of(data, offsets, GAP)
            first, code = distinct_spans(data, starts, lens)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
            _, lead = np.unique(row * max(len(first), 1) + code, return_index=True)
            raw = data.tobytes()
            terms = [raw[s:s + n] for s, n in zip(starts[lead], lens[lead])]
            take = pa.array(row[lead])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(terms, pa.binary()),
                 pa.array(span_hashes(padded(data), starts[lead], lens[lead]).view(np.int64))],
                ["query", "item_id", "term", "hash"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return materialise(rows.mapInArrow(run, f"query long, item_id {kind}, term binary, hash long"), "query-terms")


def _in_rows(batches, names):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(batch.schema.get_field_index(n))[i].as_buffer() for n in names}, batch, i


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of ``index`` for every row of ``queries``:
    item_id, rank, doc_id, score. Equal scores go by ascending doc_id (NULL
    last), documents with score 0 are left out; a query whose text is NULL,
    empty or holds no indexed term has no rows. A repeated query row is
    answered again, a repeated document row is ranked again. Queries are dealt
    in blocks of about ``QUERY_TERMS`` (query, term) rows, each one pass over
    the segments."""
    asked = query_terms(queries, id_col, text_col)
    stats = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    scorer = Scorer(stats["n"] or 0, stats["l"] or 0)
    blocks = max(1, -(-asked.count() // QUERY_TERMS))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    heaps = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "term", "hash").collect()
        found = _search_block(index, part, scorer, k, kind)
        found = materialise(found, "heaps") if blocks > 1 else found
        heaps = found if heaps is None else heaps.unionByName(found)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, part: list, scorer: Scorer, k: int, kind: str) -> DataFrame:
    """(query, doc_id, score): the heaps of all tasks for some queries."""
    hash_of = {bytes(r["term"]): r["hash"] for r in part}
    terms = sorted(hash_of)
    place = {t: i for i, t in enumerate(terms)}
    hashes = np.array([hash_of[t] for t in terms], np.int64).view(np.uint64)
    wanted: dict[int, list[int]] = {}
    for r in part:
        wanted.setdefault(r["query"], []).append(place[bytes(r["term"])])

    def held(batches):
        total = np.zeros(len(terms), np.int64)
        for row, _, _ in _in_rows(batches, ["hashes", "terms", "ends", "held"]):
            at = Lists(row)
            j = at.find(terms, hashes)
            total[j >= 0] += at.held[j[j >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    df = np.zeros(len(terms), np.int64)
    for r in (index.select("hashes", "terms", "ends", "held").mapInArrow(held, "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).collect()):              # at most a row a term of the block
        df[r["term"]] = r["n"]
    weights = [scorer.weight(int(n)) if n else 0 for n in df]
    columns = [c.split()[0] for c in SEGMENT.split(", ")]

    def run(batches):
        heaps: dict[int, list] = {q: [] for q in wanted}
        for row, batch, i in _in_rows(batches, columns):
            at = Lists(row)
            ids = batch.column(batch.schema.get_field_index("ids"))[i].values
            size = at.sizes.astype(np.int64)
            order = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            parts = scorer.part(at.often.astype(np.int64), at.long.astype(np.int64))
            most = np.maximum.reduceat(parts, at.edges[:-1]) if len(at.counts) else parts
            j = at.find(terms, hashes)
            lists = {t: (weights[t], int(at.lists[p]), most[at.lists[p]:at.lists[p + 1]])
                     for t, p in enumerate(j) if p >= 0}
            for q, ts in wanted.items():
                heap = heaps[q]
                floor = heap[-1][0] if len(heap) == k else 1
                doc, score = best_of_segment(at, size, [lists[t] for t in ts if t in lists], scorer, k, floor)
                if len(doc):
                    top = np.lexsort((order[doc], -score))[:k]
                    named = ids.take(pa.array(doc[top])).to_pylist()
                    heaps[q] = sorted(heap + list(zip(score[top].tolist(), named)), key=_order)[:k]
        out = [(q, d, s) for q, heap in heaps.items() for s, d in heap]
        q, d, s = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, id_type), pa.array(s, pa.int64())],
                                         ["query", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    return index.select("ids", *columns).mapInArrow(run, f"query long, doc_id {kind}, score long")
