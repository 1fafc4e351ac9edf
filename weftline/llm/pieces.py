"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch (a run of space marks and what follows it; no piece crosses such a boundary) are
concatenated and indexed by a suffix array over the first characters of each suffix, as many as the longest piece
has. Every piece of the vocabulary is binary-searched for its range of occurrences; the resulting edges are sorted by
position. The model is of the BPE kind, so the edges are relaxed in the order its merges take: the best-scored edge
over two neighbouring symbols joins first, the leftmost of equals, until none is left. Symbols that are no piece
become byte pieces. A long chunk is relaxed region by region, cut where no edge crosses, which changes nothing.

Memory: a task matches about AT_ONCE characters at a time, long texts in sections that end at chunk ends, long chunks
in windows. Chunks that are met again are remembered up to REMEMBERED bytes per worker. Only a region without a cut has to
fit as a whole (about 150 bytes a character); where a vocabulary has pieces that cross a boundary, a whole text is one chunk.

Defined results: a null or empty text has no tokens; repeated rows are encoded each; decoding returns the text
exactly but for a literal U+2581, which the model reads as a space (its normaliser is the identity, checked on loading); an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

#: Parameter: the model file; the driver reads it and ships its bytes, so executors need no such path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of chunks, as estimated, that a worker remembers in each of two generations.
REMEMBERED = 16 << 20
#: Characters that are matched at once, and of the texts that are taken from a batch together.
AT_ONCE, TEXTS = 200_000, 500_000
#: No merge; the longest region whose neighbours are looked through one by one; the longest whose edges are a dictionary.
NEVER, SHORT, MIDDLE = 1 << 60, 64, 20_000
#: Bits of a position in an entry of the heap.
PLACE = 40
CHUNK = re.compile(MARK + "+[^" + MARK + "]*|[^" + MARK + "]+")
CHUNK_START = re.compile("(?<!" + MARK + ")" + MARK)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` codes at least: the first of them packed into a word, then by prefix doubling."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    letters = np.zeros(int(codes.max()) + 2, np.int64)
    letters[codes] = 1
    letter = np.cumsum(letters)[codes]  # 1 for the least code that occurs; 0 stands for the end
    bits = int(letter.max()).bit_length()
    width = min(depth, 62 // bits)
    packed, padded = np.zeros(n, np.int64), np.concatenate([letter, np.zeros(width, np.int64)])
    for k in range(width):
        packed = (packed << bits) | padded[k : k + n]
    while True:
        order = np.argsort(packed)
        if width >= depth:
            return order
        ordered = packed[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:]
        packed = rank * (n + 2) + second
        width *= 2


class Pieces:
    """The vocabulary of a model and what it takes to match it."""

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.pieces = {model.id_to_piece(i): i for i in ids if not model.is_byte(i)}
        self.single = {p: np.int32(i).tobytes() for p, i in self.pieces.items() if len(p) == 1}
        # Merge order: the best score first, so that the least number wins.
        ranked = sorted(self.pieces.values(), key=lambda i: (-model.get_score(i), i))
        self.order_of = np.zeros(model.get_piece_size(), np.int64)
        self.order_of[ranked] = np.arange(len(ranked))
        self.ranked = np.array(ranked, np.int32)
        self.by_order = [np.int32(i).tobytes() for i in ranked]
        self.table = [b" \xe2\x81\x87 "] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            self.table[i] = b"" if model.is_control(i) else self.table[i]
        for p, i in self.pieces.items():
            self.table[i] = p.encode()
        for b, i in self.byte_ids.items():
            self.table[i] = bytes([b])
        probe = "  a½ ﬁ　b  "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalises its input; only models with the identity are supported")
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.pieces)
        # Longer pieces than one symbol, in code point order, as fixed-width rows for the searches.
        self.long = sorted((p for p in self.pieces if len(p) > 1))
        self.width = max((len(p) for p in self.long), default=1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(2, self.width + 1):
            of = [p for p in self.long if len(p) == length]
            if of:
                self.by_length[length] = (np.array(of, dtype=f"<U{length}"), np.array([self.pieces[p] for p in of], np.int64))
        self.length_by_order = [0] * len(ranked)
        for p, i in self.pieces.items():
            self.length_by_order[self.order_of[i]] = len(p)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece) of every occurrence in a text, sorted by position and length."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        order = suffix_array(codes, self.width)
        padded = np.concatenate([codes, np.zeros(self.width, np.uint32)])
        # The suffixes' first characters, in suffix order, are sorted at every length; each piece is searched in them.
        first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[order])
        at, length_of, piece = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for length, (words, ids) in self.by_length.items():
            keys = np.ndarray(len(codes), f"<U{length}", first, strides=(4 * self.width,))
            low, high = np.searchsorted(keys, words, "left"), np.searchsorted(keys, words, "right")
            many = high - low
            rank = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
            at.append(order[rank])
            length_of.append(np.full(len(rank), length, np.int64))
            piece.append(np.repeat(ids, many))
        pos, lens, got = np.concatenate(at), np.concatenate(length_of), np.concatenate(piece)
        by = np.argsort(pos << 8 | lens)  # no two edges share both; plain sorts of numbers are the fast ones
        return pos[by], lens[by], got[by]

    def relax(self, chunk: str, found: dict[int, int]) -> bytes:
        """The merges over the edges found in a short chunk, start * (length + 1) + end -> merge order; ids as int32 bytes."""
        n = len(chunk)
        bound = list(range(n + 1))
        m, get = n + 1, found.get
        order = [get(i * m + i + 2, NEVER) for i in range(n - 1)]
        while order and (best := min(order)) != NEVER:
            k = order.index(best)
            del bound[k + 1], order[k]
            if k < len(order):
                order[k] = get(bound[k] * m + bound[k + 2], NEVER)
            if k:
                order[k - 1] = get(bound[k - 1] * m + bound[k + 1], NEVER)
        return self.written(chunk, bound, found.__getitem__)

    def written(self, chunk: str, bound: list[int], order_at: Callable[[int], int]) -> bytes:
        """The ids of a chunk cut at the bounds."""
        m, by_order, single, out = len(chunk) + 1, self.by_order, self.single, []
        for i, j in zip(bound, bound[1:], strict=False):
            if j - i > 1:
                out.append(by_order[order_at(i * m + j)])
            else:
                out.append(single.get(chunk[i]) or self.spell(chunk[i]))
        return b"".join(out)

    def relax_long(self, chunk: str, keys: np.ndarray, orders: np.ndarray) -> bytes:
        """The same merges with a heap, for regions where looking through all neighbours each time would be slow."""
        n = len(chunk)
        m = n + 1
        if n <= MIDDLE:
            found = dict(zip(keys.tolist(), orders.tolist(), strict=True))
            get = lambda k: found.get(k, NEVER)
        else:
            get = lambda k: int(orders[p]) if (p := int(keys.searchsorted(k))) < len(keys) and keys[p] == k else NEVER
        end, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        of_two = np.flatnonzero(keys % m - keys // m == 2)
        heap = ((orders[of_two] << PLACE) | (keys[of_two] // m)).tolist()
        heapify(heap)
        place, length = (1 << PLACE) - 1, self.length_by_order
        while heap:
            entry = heappop(heap)
            i = entry & place
            mid = end[i]
            # Gone into its left neighbour, the last one, or not the pair of that length any more.
            if mid < 0 or mid >= n or (j := end[mid]) - i != length[entry >> PLACE]:
                continue
            end[i], end[mid] = j, -1
            if j < n:
                before[j] = i
                if (o := get(i * m + end[j])) != NEVER:
                    heappush(heap, o << PLACE | i)
            if i > 0 and (o := get(before[i] * m + j)) != NEVER:
                heappush(heap, o << PLACE | before[i])
        bound = [0]
        while bound[-1] < n:
            bound.append(end[bound[-1]])
        return self.written(chunk, bound, get)

    def relax_regions(self, chunk: str, first: np.ndarray, lens: np.ndarray, orders: np.ndarray) -> bytes:
        """A long chunk, cut at the places that no edge crosses: no merge can cross them either."""
        n = len(chunk)
        depth = np.bincount(first + 1, minlength=n + 2) - np.bincount(first + lens, minlength=n + 2)
        cuts = np.concatenate(([0], np.flatnonzero(np.cumsum(depth)[1:n] == 0) + 1, [n]))
        at = np.searchsorted(first, cuts)
        out = []
        for a, b, x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a == 1:
                out.append(self.single.get(chunk[a]) or self.spell(chunk[a]))
                continue
            start = first[x:y] - a
            keys = start * (b - a + 1) + start + lens[x:y]
            if b - a <= SHORT:
                out.append(self.relax(chunk[a:b], dict(zip(keys.tolist(), orders[x:y].tolist(), strict=True))))
            else:
                out.append(self.relax_long(chunk[a:b], keys, orders[x:y]))
        return b"".join(out)

    def spell(self, symbol: str) -> bytes:
        return np.array([self.byte_ids.get(b, self.unknown) for b in symbol.encode("utf-8", "surrogatepass")], np.int32).tobytes()

    def relax_many(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pos: np.ndarray, lens: np.ndarray, orders: np.ndarray) -> list[bytes]:
        """The ids of many short chunks of a text: all of them take their next merge together, round by round."""
        none = np.int64(1 << 30)
        table = np.full((len(codes) + 1, self.width + 1), none)
        table[pos, lens] = orders
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(chunk))
        end, done = begin + 1, []

        def order_of_pairs(k: np.ndarray) -> np.ndarray:
            """The order of the merge of symbols k and k + 1, where they are of one chunk and their text is a piece."""
            after = np.minimum(k + 1, len(chunk) - 1)
            length = end[after] - begin[k]
            return np.where((k + 1 < len(chunk)) & (chunk[after] == chunk[k]) & (length <= self.width), table[begin[k], np.minimum(length, self.width)], none)

        order = order_of_pairs(np.arange(len(chunk)))
        while len(chunk):
            first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            best = np.minimum.reduceat((order << 32) | np.arange(len(chunk)), first)  # the leftmost of equals
            open_ = (best >> 32) < none
            if not open_.all():
                stays = np.repeat(open_, np.diff(np.append(first, len(chunk))))
                done.append((chunk[~stays], begin[~stays], end[~stays]))
                at = (best[open_] & 0xFFFFFFFF) - np.cumsum(~stays)[best[open_] & 0xFFFFFFFF]
                chunk, begin, end, order = chunk[stays], begin[stays], end[stays], order[stays]
            else:
                at = best & 0xFFFFFFFF
            if not len(chunk):
                break
            end[at] = end[at + 1]
            kept = np.ones(len(chunk), bool)
            kept[at + 1] = False
            chunk, begin, end, order = chunk[kept], begin[kept], end[kept], order[kept]
            at = at - np.arange(len(at))  # each chunk before it has lost one symbol
            order[at] = order_of_pairs(at)
            left = at[at > 0] - 1
            order[left] = order_of_pairs(left)
        chunk, begin, end = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(begin, kind="stable")
        chunk, begin, end = chunk[by], begin[by], end[by]
        length = end - begin
        ids = self.ranked[np.where(length > 1, table[begin, length], 0)]
        odd = np.flatnonzero(length == 1)
        kinds, which = np.unique(codes[begin[odd]], return_inverse=True)
        spelled = [self.single.get(c) or self.spell(c) for c in kinds.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")]
        ids[odd] = np.array([np.frombuffer(x, np.int32)[0] for x in spelled], np.int32)[which]
        count = np.ones(len(ids), np.int64)
        count[odd] = np.array([len(x) // 4 for x in spelled], np.int64)[which]
        flat = np.repeat(ids, count)
        for k, x in enumerate(spelled):
            if len(x) > 4:  # a symbol that is no piece, as bytes
                at = (np.cumsum(count) - count)[odd[which == k]]
                for j, v in enumerate(np.frombuffer(x, np.int32).tolist()):
                    flat[at + j] = v
        data = flat.astype(np.int32).tobytes()
        cut = np.concatenate(([0], np.cumsum(np.bincount(chunk, count, len(sizes)).astype(np.int64)))) * 4
        return [data[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def learn(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """(chunk, ids) of chunks of about AT_ONCE characters together."""
        text = "\x00".join(chunks) + "\x00"  # a NUL inside a chunk only hides pieces that hold one, and none does
        pos, lens, got = self.edges(text)
        sizes = np.array([len(c) for c in chunks], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        orders = self.order_of[got]
        short = sizes <= SHORT
        if short.any():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            yield from zip((c for c in chunks if len(c) <= SHORT), self.relax_many(codes, starts[short], sizes[short], pos, lens, orders), strict=True)
        for k in np.flatnonzero(~short).tolist():
            a, b = np.searchsorted(pos, (starts[k], starts[k] + sizes[k]))
            yield chunks[k], self.relax_regions(chunks[k], pos[a:b] - starts[k], lens[a:b], orders[a:b])

    def learn_long(self, chunk: str) -> bytes:
        """The ids of a chunk longer than AT_ONCE, whose edges are found window by window."""
        found = []
        for a in range(0, len(chunk), AT_ONCE):
            pos, lens, got = self.edges(chunk[a : a + AT_ONCE + self.width - 1])
            own = pos < AT_ONCE
            found.append((pos[own] + a, lens[own], self.order_of[got[own]]))
        return self.relax_regions(chunk, *(np.concatenate([f[k] for f in found]) for k in range(3)))

    def remember(self, chunk: str, ids: bytes) -> None:
        self.young[chunk] = ids
        self.young_bytes += 250 + 2 * len(chunk) + len(ids)

    def sections(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(number of the text, section with marks): texts in sections of about TEXTS characters that end at chunk ends."""
        for k, text in enumerate(texts):
            marked = MARK + text.replace(" ", MARK) if text else ""
            a = 0
            while a < len(marked):
                cut = None if self.crossing else CHUNK_START.search(marked, a + TEXTS)
                b = cut.start() if cut else len(marked)
                yield k, marked[a:b]
                a = b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[bytes]] = [[] for _ in texts]
        for run in runs(self.sections(texts), lambda s: len(s[1]), TEXTS):
            split = [[s] if self.crossing else CHUNK.findall(s) for _, s in run]
            if self.young_bytes > REMEMBERED:
                self.old, self.young, self.young_bytes = self.young, {}, 0
            young, here = self.young, {}
            new = []
            for c in {c for cs in split for c in cs if c not in young}:
                if c in self.old:
                    self.remember(c, self.old[c])
                elif len(c) > AT_ONCE:
                    here[c] = self.learn_long(c)
                else:
                    new.append(c)
            for some in runs(new, len, AT_ONCE):
                for c, ids in self.learn(some):
                    if len(c) <= SHORT:
                        self.remember(c, ids)
                    else:
                        here[c] = ids
            for (k, _), cs in zip(run, split, strict=True):
                parts[k].append(b"".join([here[c] if c in here else young[c] for c in cs] if here else map(young.__getitem__, cs)))
        return [np.frombuffer(b"".join(p), np.int32) for p in parts]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        table = self.table
        text = b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(proto: bytes) -> Pieces:
    """The vocabulary, built once per worker."""
    name = hashlib.sha256(proto).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Pieces(proto)
    return _LOADED[name]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def runs(items: Iterable, size: Callable, most: int) -> Iterator[list]:
    """The items in lists of about ``most`` characters each."""
    part, total = [], 0
    for x in items:
        part.append(x)
        total += size(x)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about TEXTS bytes of a text column, so that a few texts at a time become Python objects."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + TEXTS, "right")))
        yield batch.slice(a, b - a)
        a = b


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """A row per document: key, ids, n_tokens, round_trip (decoding the ids gives the text back)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # half a megabyte, fixed by the model
    one = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = one.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shipped.value)
        for batch in batches:
            for rows in slices(batch, 1):
                texts = rows.column(1).to_pylist()
                once = list(dict.fromkeys(texts))  # a mix repeats rows one after the other
                ids = dict(zip(once, own.encode(once), strict=True))
                back = {t: own.decode(i) == t.replace(MARK, " ") for t, i in ids.items()}
                ends = np.cumsum([0] + [len(ids[t]) for t in texts])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([ids[t] for t in texts])))
                yield pa.RecordBatch.from_arrays([rows.column(0), flat, pa.array(np.diff(ends), pa.int64()), pa.array([back[t] for t in texts], pa.bool_())], names=[key, "ids", "n_tokens", "round_trip"])

    return one.mapInArrow(work, f"`{key}` {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) from rows with token ids; null ids give an empty text."""
    shipped = tokens.sparkSession.sparkContext.broadcast(model_bytes(model))
    one = tokens.select(F.col(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    kind = one.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i) for i in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return one.mapInArrow(work, f"`{key}` {kind}, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", "round_trip", "ids")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
