"""Token counts of a piece BPE by rank-synchronous merging of ragged arrays.

Pre-tokens (a run of spaces with the word after it) are held together as one flat array of
symbols with a sequence number each.  Every step finds each sequence's lowest-rank adjacent
pair, merges it in all sequences at once and drops the sequences that have none left; what
survives is counted.  Distinct pre-tokens of a task are merged once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tensio.llm.batches import text_buffer, with_results

#: Bytes of pre-tokens whose counts a task keeps (with what an entry costs besides its text);
#: beyond it the memory is emptied and filled anew.
MEMORY_BYTES = 128 << 20
ENTRY_BYTES = 128
#: Sequences of more symbols are merged by rank buckets, which look at changed places only.
LONG_SYMBOLS = 1024
#: Symbols merged together in one pass.
CHUNK_SYMBOLS = 1 << 20
_MARK = "▁"  # stands for a space inside pieces
_NONE = np.int32(2**31 - 1)


class PieceTable:
    """Pieces, the rank of each (by score) and the pairs that merge into one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in usable}
        if any(_MARK in p.lstrip(_MARK) for p in ids):
            raise ValueError("a piece has a space after a letter: words cannot be merged apart")
        score = np.array([model.get_score(i) for i in range(size)])
        rank = np.full(size, _NONE, np.int32)
        rank[usable] = np.unique(-score[usable], return_inverse=True)[1]
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in single], np.int64)
        self.char_ids = np.array([i for _, i in single], np.int32)
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, whole = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left * size + right
        order = np.argsort(keys)
        self.size, self.rank = size, rank
        self.keys, self.whole = keys[order], whole[order].astype(np.int32)
        # A merge may make a pair of the same or a lower rank; then the places of that rank
        # must go one at a time, from the left.
        early = np.concatenate([rank[left][rank[whole] <= rank[left]], rank[right][rank[whole] <= rank[right]]])
        self.stepwise = np.zeros(int(rank[usable].max()) + 1, bool)
        self.stepwise[early] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair (no merge: the highest rank)."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        whole = np.where(known, self.whole[at], 0).astype(np.int32)
        return np.where(known, self.rank[whole], _NONE), whole


def merge(table: PieceTable, symbols: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tokens of each sequence; ``symbols`` are piece ids, below 0 where a character is not a
    piece and counts ``weights`` tokens."""
    tokens = np.zeros(len(sizes), np.int64)
    ids = np.arange(len(sizes))
    filled = sizes > 0
    ids, sizes = ids[filled], sizes[filled]
    if not len(ids):
        return tokens
    start = np.cumsum(sizes) - sizes

    def pair_up(symbols, last):
        rank, whole = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(~last[:-1]) if len(last) else np.zeros(0, np.int64)
        rank[inner], whole[inner] = table.look_up(symbols[inner], symbols[inner + 1])
        return rank, whole

    last = np.zeros(len(symbols), bool)
    last[start + sizes - 1] = True
    rank, whole = pair_up(symbols, last)
    while len(ids):
        low = np.minimum.reduceat(rank, start)
        done = low == _NONE
        if done.any():
            spread = np.repeat(done, sizes)
            tokens[ids[done]] = np.add.reduceat(weights, start)[done]
            keep = ~spread
            symbols, weights, rank, whole, last = symbols[keep], weights[keep], rank[keep], whole[keep], last[keep]
            ids, sizes, low = ids[~done], sizes[~done], low[~done]
            if not len(ids):
                break
            start = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(rank == np.repeat(low, sizes))
        # Of touching places every other one, counted from the left of their run.
        run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        take = (np.arange(len(hit)) - begin) % 2 == 0
        owner = np.searchsorted(start, hit, side="right") - 1
        slow = table.stepwise[low[owner]]
        if slow.any():
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            take &= ~slow | first
        hit, owner = hit[take], owner[take]
        symbols[hit] = whole[hit]
        last[hit] |= last[hit + 1]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        touched = np.zeros(len(symbols), bool)
        touched[hit] = True
        touched[np.maximum(hit - 1, 0)] = True
        sizes = sizes - np.bincount(owner, minlength=len(sizes))
        symbols, weights, rank, whole, last, touched = symbols[keep], weights[keep], rank[keep], whole[keep], last[keep], touched[keep]
        start = np.cumsum(sizes) - sizes
        rank[touched] = _NONE
        again = np.flatnonzero(touched & ~last)
        rank[again], whole[again] = table.look_up(symbols[again], symbols[again + 1])
    return tokens


def merge_long(table: PieceTable, symbols: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """As ``merge``, for long sequences: symbols stay in place as a linked list, and the places of each
    rank wait in a bucket.  The lowest rank of all sequences goes next, in all of them at once; only
    the pairs beside a merge are looked up again, so the work follows the merges.
    """
    n = len(symbols)
    ends = np.cumsum(sizes)
    start = ends - sizes
    last = np.zeros(n + 1, bool)
    last[ends - 1] = True
    after, before = np.arange(1, n + 1), np.arange(-1, n)  # one more place behind the last
    alive = np.ones(n, bool)
    symbols = symbols.copy()
    rank, whole = np.full(n, _NONE), np.zeros(n, np.int32)
    buckets: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def look(places: np.ndarray) -> None:
        rank[places] = _NONE
        inner = places[~last[places]]
        rank[inner], whole[inner] = table.look_up(symbols[inner], symbols[after[inner]])
        inner = inner[rank[inner] != _NONE]
        order = inner[np.argsort(rank[inner], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            wait(int(rank[part[0]]), part)

    def wait(r: int, places: np.ndarray) -> None:
        if r not in buckets:
            buckets[r] = []
            heapq.heappush(queue, r)
        buckets[r].append(places)

    look(np.arange(n))
    while queue:
        r = heapq.heappop(queue)
        hit = np.unique(np.concatenate(buckets.pop(r)))
        hit = hit[alive[hit] & (rank[hit] == r)]
        if not len(hit):
            continue
        if table.stepwise[r]:
            # One at a time in each sequence, from the left; the others wait.
            owner = np.searchsorted(start, hit, side="right")
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            if not first.all():
                wait(r, hit[~first])
            hit = hit[first]
        else:
            run = np.concatenate([[True], hit[1:] != after[hit[:-1]]])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
        gone = after[hit]
        symbols[hit] = whole[hit]
        alive[gone] = False
        last[hit] |= last[gone]
        after[hit] = after[gone]
        before[after[hit]] = hit
        left = before[hit]
        left = left[left >= 0]
        look(np.unique(np.concatenate([hit, left[~last[left]]])))
    return np.add.reduceat(np.where(alive, weights, 0), start)


def _pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts, each text with one space put before it, and their count per text.

    A cut goes before a space whose left neighbour is no space (nor the mark that stands for
    one): no piece crosses such a place.
    """
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[:-1][full]
    buf = np.insert(data, at, 32)
    heads = at + np.arange(len(at))
    cut = np.zeros(len(buf), bool)
    if len(buf):
        gap = buf == 32
        mark = np.zeros(len(buf), bool)
        mark[2:] = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
        cut[1:] = gap[1:] & ~gap[:-1] & ~mark[:-1]
        cut[heads] = True
    places = np.flatnonzero(cut)
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[full] = np.diff(np.append(np.searchsorted(places, heads), len(places)))
    ends = np.append(places, len(buf)).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(buf)])
    return tokens, counts


def _count(table: PieceTable, words: list[bytes]) -> np.ndarray:
    """Tokens of each distinct pre-token."""
    out = np.zeros(len(words), np.int64)
    start = 0
    while start < len(words):
        stop, total = start, 0
        while stop < len(words) and (stop == start or total + len(words[stop]) <= CHUNK_SYMBOLS):
            total += len(words[stop])
            stop += 1
        raw = np.frombuffer(b"".join(words[start:stop]), np.uint8)
        ends = np.cumsum([len(w) for w in words[start:stop]])
        lead = (raw & 0xC0) != 0x80
        seen = np.concatenate([[0], np.cumsum(lead)])
        sizes = np.diff(seen[np.concatenate([[0], ends])])
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").replace(" ", _MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.searchsorted(table.chars, codes)
        at[at == len(table.chars)] = 0
        known = table.chars[at] == codes
        symbols = np.where(known, table.char_ids[at], -1).astype(np.int32)
        octets = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        # A merged symbol keeps its left part's weight, which is 1 for every piece.
        weights = np.where(known, 1, octets)
        long = sizes > LONG_SYMBOLS
        spread = np.repeat(long, sizes)
        counts = np.zeros(len(sizes), np.int64)
        if long.any():
            counts[long] = merge_long(table, symbols[spread], sizes[long], weights[spread])
            symbols, weights = symbols[~spread], weights[~spread]
        counts[~long] = merge(table, symbols, sizes[~long], weights)
        out[start:stop] = counts
        start = stop
    return out


def with_token_counts(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but ``text``), ``n_bytes`` and ``n_tokens``.

    ``model_path`` names a BPE piece model with byte fallback and identity normalisation,
    readable on every worker.  NULL and empty texts have 0 tokens.  One pass, no shuffle.  A
    text without spaces is one sequence; its time grows with its length, not with its square.
    Input columns named like a result are left out.
    """

    def start():
        table, memory, held = PieceTable(model_path), {}, 0

        def compute(texts: pa.Array) -> list[pa.Array]:
            nonlocal held
            data, offsets = text_buffer(texts)
            tokens, counts = _pretokens(data, offsets)
            coded = tokens.dictionary_encode()
            words = coded.dictionary.to_pylist()
            if held > MEMORY_BYTES:
                memory.clear()
                held = 0
            new = [w for w in words if w not in memory]
            held += sum(map(len, new)) + ENTRY_BYTES * len(new)
            memory.update(zip(new, _count(table, new).tolist(), strict=True))
            each = np.fromiter((memory[w] for w in words), np.int64, len(words))
            run = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])]) if len(words) else np.zeros(1, np.int64)
            edge = np.concatenate([[0], np.cumsum(counts)])
            return [pa.array(np.diff(offsets)), pa.array(run[edge[1:]] - run[edge[:-1]])]

        return compute

    return with_results(df, text, [c for c in df.columns if c != text] if keep is None else keep, "n_bytes long, n_tokens long", start)
