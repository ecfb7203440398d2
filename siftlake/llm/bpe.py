"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by offsets."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm.common import adds, by_batches, read

OTHER, LETTER, NUMBER, SPACE, EDGE = 0, 1, 2, 3, 4
#: The code points of Unicode's White_Space, which the pattern's \s stands for.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Code points that one pass of the scan looks at, at most.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other.

    Letters and numbers are those of the Unicode version that the tiktoken library has: it is asked once which
    code points it keeps of a text that holds them all, with single bytes as ranks.
    """
    import tiktoken

    classes = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        asked = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(asked.encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    classes[list(WHITE_SPACE)] = SPACE
    return classes


def _function(*to: int) -> int:
    """A function on the four states, two bits for the image of each."""
    return sum(x << (2 * s) for s, x in enumerate(to))


# States after a code point: 0 nothing open; 1 a blank that the next word takes; 2, 3 one or two letters of a contraction due.
_STEP, _BLANK, _SHORT, _LONG = _function(0, 0, 0, 2), _function(1, 1, 1, 1), _function(2, 0, 2, 2), _function(3, 0, 3, 3)


@lru_cache(maxsize=1)
def _compositions() -> np.ndarray:
    """For functions f and g, at f * 256 + g: first f, then g."""
    f, g = np.arange(256)[:, None], np.arange(256)[None, :]
    out = np.zeros((256, 256), np.int64)
    for s in range(4):
        out |= ((g >> (2 * ((f >> (2 * s)) & 3))) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


def scan_states(functions: np.ndarray) -> np.ndarray:
    """The state after each element, from state 0, by a blocked scan over the composition of functions."""
    n, width = len(functions), 64
    if n <= width:
        state, out = 0, np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            state = (f >> (2 * state)) & 3
            out[i] = state
        return out
    table, blocks = _compositions(), -(-n // width)
    padded = np.full(blocks * width, _function(0, 1, 2, 3), np.uint8)
    padded[:n] = functions
    steps = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for j in range(1, width):
        steps[j] = table[(steps[j - 1].astype(np.uint16) << 8) | steps[j]]
    enter = np.concatenate((np.zeros(1, np.uint8), scan_states(steps[-1])[:-1]))
    return ((steps >> (2 * enter)[None, :]) & 3).T.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in ``points``, the code points of texts one after another that start at ``first``.

    The pattern is public_tokenizers.PATTERN. Its choices depend on the classes of neighbours, on whether a blank
    before the word still waits for it, and on contractions; the last two are the states of a small automaton,
    whose transition functions are composed by an associative scan.
    """
    n = len(points)
    kind = codepoint_classes()[points]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    head, tail = head[:n], head[1:]
    before = np.concatenate((np.full(1, EDGE, np.uint8), kind[:-1]))
    before[head] = EDGE
    after = np.concatenate((kind[1:], np.full(1, EDGE, np.uint8)))
    after[tail] = EDGE
    word_next = after < SPACE
    functions = np.full(n, _STEP, np.uint8)
    functions[(points == 0x20) & word_next] = _BLANK
    marks = np.flatnonzero((points == 0x27) & (before != OTHER) & (after == LETTER))
    if len(marks):
        one = points[marks + 1]
        inside = ~tail[marks + 1]
        two = np.where(inside, points[np.minimum(marks + 2, n - 1)], 0)
        functions[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _SHORT
        functions[marks[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = _LONG
    heads = functions[head] & 3
    functions[head] = heads * 0b01010101  # texts begin in state 0, whatever came before
    state = scan_states(functions)
    last = np.concatenate((np.zeros(1, np.uint8), state[:-1]))
    last[head] = 0
    earlier = np.concatenate((np.zeros(1, np.uint8), last[:-1]))
    earlier[head] = 0
    return head | ((last == 0) & ((kind != before) | ((kind == SPACE) & word_next) | (earlier == 2)))


class Vocabulary:
    """Ranks of byte strings; their ids are the ranks."""

    def __init__(self, ranks_file: bytes):
        lines = [line.split() for line in ranks_file.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: always the neighbouring pair of the lowest rank, leftmost first, becomes one."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge_long(piece) if len(piece) > 200 else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap, in n log n steps; entries of pairs that have changed meanwhile are passed over."""
        n, get = len(piece), self.ranks.get
        end, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            gone[j], end[i] = 1, stop
            if stop < n:
                previous[stop] = i
                if (rank := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (h := previous[i]) >= 0 and (rank := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (rank, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ``ids``; ``offsets``, where each one's bytes begin, saves summing up lengths."""
        lengths = self.length[ids]
        if offsets is None:
            offsets = np.cumsum(lengths) - lengths
        out = []
        for a in range(0, len(ids), CHUNK):
            part, size = ids[a : a + CHUNK], lengths[a : a + CHUNK]
            begin = offsets[a : a + CHUNK].astype(np.int64)
            at = np.repeat(self.start[part] - (begin - begin[0]), size)
            at += np.arange(len(at))
            out.append(self.flat[at].tobytes())
        return b"".join(out)


class _Merged(dict):
    """Pre-token to its packed ids. It is emptied when it holds ``most`` pre-tokens; long ones aren't kept."""

    def __init__(self, vocabulary: Vocabulary, most: int = 150_000, longest: int = 40):
        self.vocabulary, self.most, self.longest = vocabulary, most, longest

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.vocabulary.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.merged = vocabulary, _Merged(vocabulary)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= CHUNK:
                yield from self._encode(group)
                group, held = [], 0
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        starts = np.flatnonzero(boundaries(points, first[sizes > 0])) if len(points) else np.zeros(0, np.int64)
        at = np.searchsorted(starts, np.concatenate((first, [len(points)])))
        for k, text in enumerate(texts):
            own = (starts[at[k] : at[k + 1]] - first[k]).tolist()
            pieces = map(text.__getitem__, map(slice, own, [*own[1:], len(text)]))
            yield np.frombuffer(b"".join(map(self.merged.__getitem__, pieces)), "<u4")


@lru_cache(maxsize=2)
def _vocabulary(ranks_file: bytes) -> Vocabulary:
    return Vocabulary(ranks_file)


def _ranks(df: DataFrame, path: str | None):
    """The rank file, read on the driver and broadcast: a few hundred kB whatever the input."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _parts(batch: pa.RecordBatch, column: str, most: int = 2 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values have ``most`` bytes together, or of single larger ones; nothing is copied."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    a = held = 0
    for i, n in enumerate(sizes):
        if i > a and held + n > most:
            yield batch.slice(a, i - a)
            a, held = i, 0
        held += n
    if len(sizes) > a:
        yield batch.slice(a)


@adds("token_ids", "token_offsets", "n_tokens", "round_trip")
def encode(docs: DataFrame, text: str = "text", ranks_path: str | None = None, verify: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each whole text: token_ids and token_offsets (bytes of little-endian unsigned 32-bit integers; the second tells at which byte of the text each token begins) and n_tokens.

    Boundaries of pre-tokens come from arrays of code point classes and a scan over transition functions, for many
    texts at once; each slice is merged once per worker while the bounded cache holds it. Special tokens don't
    exist: their strings are ordinary text. Nothing is shuffled; of the table's columns only ``keep`` (all) come back. With ``verify`` the ids are decoded at once, and
    round_trip tells whether they give the text's bytes.

    Null counts as empty, which has no tokens. A single very long text is scanned alone; a run without boundaries
    is merged by a heap. Extra columns pass through, those named as the added ones are replaced. Rows are encoded
    independently, so ties and repeated rows need no rule; an empty table gives no rows.
    """
    added = [T.StructField("token_ids", T.BinaryType()), T.StructField("token_offsets", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("round_trip", T.BooleanType())] * verify]
    names = [f.name for f in added]
    ranks, keep = _ranks(docs, ranks_path), docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks.value)
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _parts(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids, offsets, counts, exact = [], [], [], []
                for t, x in zip(texts, encoder.encode(texts), strict=True):
                    size = vocabulary.length[x]
                    at = (np.cumsum(size) - size).astype("<u4")
                    ids.append(x.tobytes())
                    offsets.append(at.tobytes())
                    counts.append(len(x))
                    if verify:
                        exact.append(vocabulary.decode(x, at) == t.encode())
                columns = [pa.array(ids, pa.binary()), pa.array(offsets, pa.binary()), pa.array(counts, pa.int64()), *[pa.array(exact, pa.bool_())] * verify]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, *names])

    return by_batches(docs, run, T.StructType([*(docs.schema[c] for c in keep), *added]))


@adds("decoded")
def decode(tokens: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Add ``decoded``, the bytes that token_ids stand for, placed by token_offsets.

    Null ids give null, empty ones nothing. Ids which the vocabulary lacks raise an IndexError. Very long rows are decoded
    in pieces of CHUNK ids. Rows are independent, so ties and repeated rows need no rule. Extra columns pass through, one
    named decoded is replaced. An empty table gives no rows.
    """
    ranks, keep = _ranks(tokens, ranks_path), tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks.value)
        for batch in batches:
            for part in _parts(batch, "token_ids"):
                ids, offsets = (part.column(c).to_pylist() for c in ("token_ids", "token_offsets"))
                out = [None if x is None else vocabulary.decode(np.frombuffer(x, "<u4"), np.frombuffer(o, "<u4") if o is not None else None) for x, o in zip(ids, offsets, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    return by_batches(tokens, run, T.StructType([*tokens.schema, T.StructField("decoded", T.BinaryType())]))


def op8_bpe(spark, sf_dir):
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    decoded = decode(encoded)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
