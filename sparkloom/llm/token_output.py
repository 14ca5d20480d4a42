"""Token-ID / binary output: canonical length-limited Huffman files.

Texts become token ids (tokenizers library), global id counts give one canonical
code whose lengths never exceed a limit, and the coded ids go to self-contained
file images in ascending doc_id order.  Each document starts on a byte; within
it every ``block`` ids a bit offset is kept, so that blocks decode independently
of each other through one lookup table.

A data set is two tables in the shared folder: ``codebook`` (one row: the code
length of each id) and ``images`` (shard, seq, image), written and committed by
Spark so that a lost executor leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, quantile_bounds, scratch_path, text_buffer, tidy, written

MAGIC = 0x31465548  # "HUF1"
BLOCK = 512
MAX_LENGTH = 18
IDS_PER_SHARD = 4_000_000
IDS_PER_IMAGE = 2_000_000
#: Shards are tasks; beyond so many they hold more ids each, in images of the same size.
MAX_SHARDS = 100_000
#: Pieces that one Python worker keeps, about 40 MB.
CACHE_ENTRIES = 450_000
#: Bytes of text that are cut and looked up at once.
TEXT_BYTES = 5 << 20
#: Uses of a piece that keep it when there are too many.
OFTEN = 3


# ------------------------------------------------------------------- tokenizing


LETTER, DIGIT, SIGN, BLANK, ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each code point below 65,536 in the pattern of byte-level BPE.
    ODD: code points that Unicode versions may tell apart differently."""
    import unicodedata

    out = np.full(1 << 16, SIGN, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            out[c] = LETTER if kind[0] == "L" else DIGIT
        elif kind in ("Cn", "Cs"):
            out[c] = ODD
    # White space.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x180E]] = ODD
    return out


class ChunkTokenizer:
    """Byte-level BPE of whole texts, one library call for many new pieces.

    The pattern of byte-level BPE cuts a text into pieces that are encoded
    independently, so a text's ids are those of its pieces, and ids of pieces seen
    before come from a bounded cache.  The cuts are found for all bytes of a batch
    at once.  Texts with literal special tokens or odd code points, and tokenizers
    of another kind, are passed to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        rule = self.whole.pre_tokenizer
        line_end = self.whole.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if line_end else None
        self.text_rule, self.piece_rule, self.alphabet = rule, pre_tokenizers.CharDelimiterSplit("\n"), self._alphabet()
        self.byte_level = len(line_end) == 1 and self.whole.normalizer is None and rule is not None and type(rule).__name__ == "ByteLevel" and not rule.add_prefix_space and rule.use_regex
        self.classes = _classes()
        self._clear()

    @staticmethod
    def _alphabet() -> str:
        """The printable character that stands for each byte; 0xFF, which UTF-8
        never has, becomes the delimiter."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        out, spare = [], 256
        for b in range(256):
            if b in printable:
                out.append(chr(b))
            else:
                out.append(chr(spare))
                spare += 1
        out[255] = "\n"
        return "".join(out)

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.start, self.size, self.used, self.ids = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind))

    def _thin(self) -> None:
        """Keeps the pieces that came up OFTEN times, if they are less than half."""
        keep = self.used >= OFTEN
        known, start, size, used, ids = self.known.filter(pa.array(keep)), self.start[keep], self.size[keep], self.used[keep], self.ids
        self._clear()
        if 2 * len(known) < len(keep):
            self._put(known, size, ids[np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)])
            self.used = used

    def _put(self, names: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size, self.used, self.ids = np.append(self.size, size), np.append(self.used, np.zeros_like(size)), np.append(self.ids, ids)
        self.known = pa.concat_arrays([self.known, names])

    def _learned(self, fresh: pa.Array) -> np.ndarray:
        """Encodes pieces and adds them; their places."""
        names = fresh.to_pylist()
        lines = np.fromiter((b"\n" in p for p in names), bool, len(names))
        out = np.empty(len(names), np.int64)
        if lines.any():
            some = [names[k] for k in np.flatnonzero(lines).tolist()]
            ids = [e.ids for e in self.whole.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            out[lines] = len(self.known) + np.arange(len(some))
            self._put(pa.array(some, pa.large_binary()), np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), self.kind))
            names = [names[k] for k in np.flatnonzero(~lines).tolist()]
        if names:
            # One text of all pieces, cut by the delimiter alone.
            text = b"\xff\n\xff".join(names).decode("latin1").translate(self.alphabet)
            self.whole.pre_tokenizer = self.piece_rule
            try:
                flat = np.asarray(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            finally:
                self.whole.pre_tokenizer = self.text_rule
            stops = np.append(np.flatnonzero(flat == self.line_end), len(flat))
            out[~lines] = len(self.known) + np.arange(len(names))
            self._put(fresh.filter(pa.array(~lines)), np.diff(stops, prepend=-1) - 1, flat[flat != self.line_end])
        return out

    def _class_of(self, raw: np.ndarray) -> np.ndarray:
        """The class of the code point that each UTF-8 byte belongs to."""
        kind = self.classes[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            a, b, c, d = (raw[np.minimum(lead + k, len(raw) - 1)].astype(np.uint32) for k in range(4))
            two, three = a < 0xE0, (a >= 0xE0) & (a < 0xF0)
            code = np.where(two, (a & 31) << 6 | b & 63, np.where(three, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
            own = self.classes[np.minimum(code, 0xFFFF)]
            far = code > 0xFFFF
            if far.any():
                import unicodedata

                names, back = np.unique(code[far], return_inverse=True)
                own[far] = np.asarray([ODD if unicodedata.category(chr(x))[0] in "LN" else SIGN for x in names.tolist()], np.uint8)[back]
            kind[lead] = own
            for k, some in ((1, None), (2, ~two), (3, ~two & ~three)):
                at = lead + k if some is None else lead[some] + k
                kind[at] = own if some is None else own[some]
        return kind

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """First bytes of all pieces of non-empty texts, one after another."""
        n = len(raw)
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        change = head[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        after_space = np.zeros(n, bool)
        after_space[1:] = (raw[:-1] == 32) & ~head[1:n]
        cut = change & (blank | ~after_space)
        # The last blank before something else stands alone, or at its head if it is a space.
        follows = np.flatnonzero(change & ~blank & ~head[:n])
        last = follows[blank[follows - 1]] - 1
        while len(last) and (more := (raw[last] & 0xC0) == 0x80).any():
            last = last - more
        cut[last] = True
        # 's, 't, 'm, 'd, 're, 've and 'll where no space or sign leads.
        at = np.flatnonzero((raw[: n - 1] == 39) & cut[: n - 1] & (kind[1:] == LETTER) & ~head[1:n])
        if len(at):
            first = raw[at + 1]
            one = np.isin(first, list(b"stmd"))
            second = raw[np.minimum(at + 2, n - 1)]
            two = (at + 2 < n) & ~head[np.minimum(at + 2, n)] & (((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108))
            cut[at[one | two] + 1] = False
            rest = np.where(one, at + 2, at + 3)[one | two]
            rest = rest[rest < n]
            cut[rest[kind[rest] == LETTER]] = True
        return np.flatnonzero(cut)

    def encoded(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of an Arrow column one after another, and how many
        each has; null: empty.  ``end_id`` follows each text unless it is None."""
        raw, offsets = text_buffer(column)
        n = len(offsets) - 1
        odd = np.zeros(n, bool)
        size, tokens = np.zeros(n, np.int64), np.zeros(0, self.kind)
        if not self.byte_level:
            odd[:] = True
        elif len(raw):
            data = raw.tobytes()
            for mark in self.special:
                at = data.find(mark)
                while at >= 0:
                    odd[np.searchsorted(offsets, at, side="right") - 1] = True
                    at = data.find(mark, at + 1)
            kind = self._class_of(raw)
            at = np.flatnonzero(kind == ODD)
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
            starts = self._cuts(raw, offsets, kind)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(data)]).dictionary_encode()
            if len(self.known) > CACHE_ENTRIES:
                self._thin()
            # A piece of an odd text may end within a mark, never within a code point.
            names, at = pieces.dictionary, np.asarray(pieces.indices)
            own = np.asarray(pc.index_in(names, value_set=self.known).fill_null(-1), np.int64)
            fresh = own < 0
            if fresh.any():
                own[fresh] = self._learned(names.filter(pa.array(fresh)))
            self.used[own] += np.bincount(at, minlength=len(own))
            each = self.size[own].astype(np.int32)[at]
            upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            where = np.repeat((self.start[own][at] - upto[:-1]).astype(np.int32), each)
            where += np.arange(len(where), dtype=np.int32)
            tokens = self.ids[where]
            size = np.diff(upto[np.searchsorted(starts, offsets)])
        if odd.any():
            parts = np.split(tokens, np.cumsum(size)[:-1]) if n else []
            for d in np.flatnonzero(odd).tolist():
                parts[d] = np.asarray(self.whole.encode(raw[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids, self.kind)
            size, tokens = np.asarray([len(p) for p in parts], np.int64), np.concatenate(parts) if parts else tokens
        if end_id is not None:
            out = np.full(len(tokens) + n, end_id, self.kind)
            out[np.arange(len(tokens)) + np.repeat(np.arange(n), size)] = tokens
            tokens, size = out, size + 1
        return tokens, size

    def __call__(self, texts: list[str]) -> list[bytes]:
        tokens, size = self.encoded(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(tokens, np.cumsum(size)[:-1])] if len(size) else []


def _batches(table: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of one column, one row at least."""
    size = np.asarray(pc.binary_length(table.column(column)).fill_null(0), np.int64)
    done = np.cumsum(size)
    first = 0
    while first < table.num_rows:
        base = done[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(done, base + limit, side="right")))
        yield table.slice(first, last - first)
        first = last


def _gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``limit`` bytes of one column."""
    held, size = [], 0
    for b in batches:
        own = b.column(column).nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """(doc_id, n_tokens, ids) of ``docs``'s doc_id and text: ids are little-endian
    unsigned 16-bit numbers, 32-bit where the vocabulary needs them.  Null text:
    empty.  ``end_id`` is appended to each document unless it is None."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        for whole in _gathered(batches, 1):
            for b in _batches(whole, 1, TEXT_BYTES):
                t = _TOKENIZERS.get(tokenizer)
                if t is None:
                    t = _TOKENIZERS[tokenizer] = ChunkTokenizer(tokenizer)
                ids, n = t.encoded(b.column(1), end_id)
                ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                coded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.full(len(n), ids.itemsize, np.int32)), coded], ["doc_id", "n_tokens", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, width int, ids binary")


# ------------------------------------------------------------------ Huffman code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge), or of as few
    as so many ids need; ids that never occur get 0, a single id gets 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    leaf_of_level, row = [], np.zeros(0, np.int64)
    for _ in range(limit):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        leaf_of_level.append(rank < n)
    take = 2 * n - 2
    length = np.zeros(n, np.int64)
    for is_leaf in reversed(leaf_of_level):
        n_leaves = int(is_leaf[:take].sum())
        length[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), most significant bit first."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    ls = lengths[used].astype(int)
    for length in range(1, int(ls.max(initial=0)) + 1):
        code <<= length - last
        last = length
        own = used[ls == length]
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code += len(own)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each prefix of the longest length: the id it starts with and its
    length."""
    top = int(lengths.max(initial=0)) or 1
    codes = canonical_codes(lengths)
    ids, size = np.zeros(1 << top, np.uint32), np.zeros(1 << top, np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (np.uint64(top) - lengths[used].astype(np.uint64)), kind="stable")]
    span = 1 << (top - lengths[used].astype(np.int64))
    filled = int(span.sum())
    ids[:filled] = np.repeat(used, span)
    size[:filled] = np.repeat(lengths[used], span)
    return ids, size, top


def pack(ids: np.ndarray, n_tokens: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[bytes]]:
    """Coded bits of each document, and its checkpoints: the bit offset within
    the document of every ``block``-th id as little-endian unsigned 64-bit."""
    size = lengths[ids].astype(np.int64)
    first = np.zeros(len(n_tokens) + 1, np.int64)
    np.cumsum(n_tokens, out=first[1:])
    plain = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=plain[1:])
    bits = plain[first[1:]] - plain[first[:-1]]
    n_bytes = (bits + 7) // 8
    start = np.zeros(len(n_tokens) + 1, np.int64)
    np.cumsum(n_bytes, out=start[1:])
    at = plain[:-1] + np.repeat(start[:-1] * 8 - plain[first[:-1]], n_tokens)
    words = np.zeros((int(start[-1]) + 7) // 8 + 2, np.uint64)
    if len(ids):
        code, word = codes[ids], at >> 6
        over = (at & 63) + size - 64
        high = np.where(over <= 0, code << np.clip(-over, 0, 63).astype(np.uint64), code >> np.clip(over, 0, 63).astype(np.uint64))
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[heads]] = np.bitwise_or.reduceat(high, heads)
        split = np.flatnonzero(over > 0)
        words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    raw = words.astype(">u8").tobytes()
    payload = [raw[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
    marks = []
    for i, n in enumerate(n_tokens.tolist()):
        a = int(first[i])
        marks.append((plain[a : a + n : block] - plain[a]).astype("<u8").tobytes())
    return payload, marks


def unpack(payload: np.ndarray, at: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Decode blocks side by side: block i has ``count[i]`` ids from bit
    ``at[i]``; their ids, block after block."""
    ids, size, top = table
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    out = np.zeros(int(first[-1]), np.uint32)
    if not len(out):
        return out
    raw = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-count, kind="stable")
    pos, to, left = at[order].copy(), first[:-1][order].copy(), count[order]
    drop = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # blocks that still have a k-th id
    for k in range(int(left[0])):
        n = int(drop[k])
        p = pos[:n]
        key = ((window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - top)).astype(np.int64)
        out[to[:n] + k] = ids[key]
        pos[:n] += size[key]
    return out


# ------------------------------------------------------------------- file format


def image_of(start: int, doc_ids: list[int | None], n_tokens: list[int], payload: list[bytes], marks: list[bytes], block: int) -> bytes:
    """One file image: eight header words (magic, documents, first document's
    start, block, checkpoints, payload bytes, 0, 0), then doc ids, a byte each
    for null ids, token counts, byte starts, checkpoints, payload."""
    body = b"".join(payload)
    mark = b"".join(marks)
    starts = np.cumsum([0, *map(len, payload)])[:-1]
    head = np.asarray([MAGIC, len(doc_ids), start, block, len(mark) // 8, len(body), 0, 0], "<i8")
    return b"".join([head.tobytes(), np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(), np.asarray(n_tokens, "<i8").tobytes(), starts.astype("<i8").tobytes(), bytes(x is None for x in doc_ids), mark, body])


def read_image(image: bytes, table: tuple[np.ndarray, np.ndarray, int]):
    """doc ids (None: null), start, token counts and all ids of one image."""
    head = np.frombuffer(image, "<i8", 8)
    if head[0] != MAGIC:
        raise ValueError("not a token file")
    n, start, block, n_marks, n_body = map(int, head[1:6])
    at = 64
    docs, tokens, byte_start = (np.frombuffer(image, "<i8", n, at + 8 * n * k) for k in range(3))
    at += 24 * n
    null = np.frombuffer(image, np.uint8, n, at)
    at += n
    marks = np.frombuffer(image, "<u8", n_marks, at).astype(np.int64)
    at += 8 * n_marks
    body = np.frombuffer(image, np.uint8, n_body, at)
    blocks = (tokens + block - 1) // block
    of = np.repeat(np.arange(n), blocks)
    upto = np.cumsum(blocks)
    within = np.arange(len(of)) - (upto - blocks)[of]
    count = np.minimum(block, tokens[of] - within * block)
    ids = unpack(body, marks + byte_start[of] * 8, count, table)
    starts = start + np.cumsum(tokens) - tokens
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], starts, tokens, ids


# --------------------------------------------------------------------- operators


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = 0, max_length: int = MAX_LENGTH, block: int = BLOCK, ids_per_shard: int = IDS_PER_SHARD) -> str:
    """Write the token files of ``docs`` (doc_id, text) below ``path`` (a fresh
    folder of the shared one by default) and return it.

    Documents go in ascending doc_id order, null ids first, repeated ids in the
    order of their coded ids.  Null texts are empty; an empty table gives a data
    set without images.  To the driver come the id counts (bounded by the
    vocabulary) and one sum for each shard.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    ids = written(tokenized(docs, tokenizer, end_id), "ids")
    total = ids.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // max(ids_per_shard, -(-total // MAX_SHARDS))))
    bounds = np.asarray(quantile_bounds(ids, "doc_id", shards), np.int64)

    def shard_of(column: pa.Array) -> np.ndarray:
        plain = np.asarray(column.fill_null(0), np.int64)
        at = np.searchsorted(bounds, plain, side="left")
        at[np.asarray(column.is_null())] = 0
        return at

    def ids_of(b: pa.RecordBatch) -> np.ndarray:
        return text_buffer(b.column("ids"))[0].view(np.uint16 if b.column("width")[0].as_py() == 2 else np.uint32)

    def tally(batches):
        counts, sums = np.zeros(1 << 10, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for whole in batches:
            for b in _batches(whole, 3, 16 << 20):
                own = np.bincount(ids_of(b))
                if len(own) > len(counts):
                    counts = np.pad(counts, (0, len(own) - len(counts)))
                counts[: len(own)] += own
                np.add.at(sums, shard_of(b.column("doc_id")), np.asarray(b.column("n_tokens")))
        used, some = np.flatnonzero(counts), np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(used), len(some)]), pa.int32()), pa.array(np.concatenate([used, some]), pa.int64()), pa.array(np.concatenate([counts[used], sums[some]]), pa.int64())], ["kind", "key", "n"])

    rows = ids.select("doc_id", "n_tokens", "width", "ids").mapInArrow(tidy(tally), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([0, *(r.key for r in rows if r.kind == 0)]) + 1, np.int64)
    base = np.zeros(len(bounds) + 1, np.int64)
    for r in rows:
        (base if r.kind else counts)[r.key] = r.n
    base = np.cumsum(base) - base
    lengths = code_lengths(counts, max_length)
    codes = canonical_codes(lengths)

    def encode(batches):
        for whole in batches:
            for b in _batches(whole, 3):
                payload, marks = pack(ids_of(b), np.asarray(b.column("n_tokens"), np.int64), lengths, codes, block)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column("doc_id")), pa.int32()), b.column("doc_id"), b.column("n_tokens"), pa.array(payload, pa.binary()), pa.array(marks, pa.binary())], ["shard", "doc_id", "n_tokens", "bits", "marks"])

    def assemble(batches):
        shard, seq, start, held = None, 0, 0, []

        def flush():
            nonlocal seq, start
            d, n, p, m = zip(*held, strict=True)
            image = image_of(start, d, n, p, m, block)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([image], pa.binary())], ["shard", "seq", "image"])
            seq += 1
            start += sum(n)
            held.clear()
            return out

        size = 0
        for whole in batches:
            for row in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                if held and (row[0] != shard or size + row[2] > IDS_PER_IMAGE):
                    yield flush()
                    size = 0
                if row[0] != shard:
                    shard, seq, start = row[0], 0, int(base[row[0]])
                held.append(row[1:])
                size += row[2]
        if held:
            yield flush()

    coded = ids.select("doc_id", "n_tokens", "width", "ids").mapInArrow(tidy(encode), "shard int, doc_id long, n_tokens long, bits binary, marks binary")
    images = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "bits").mapInArrow(tidy(assemble), "shard int, seq int, image binary")
    images.write.option("compression", "none").parquet(f"{path}/images")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    dropped(spark, ids)
    return path


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a data set: doc_id, start (ids of all documents before
    it), n_tokens and either ids (array) or ids_crc32, the unsigned CRC-32 of
    the ids as little-endian unsigned 32-bit numbers."""
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()[0]), np.uint8)

    def decode(batches):
        table = decode_table(lengths)
        for whole in batches:
            for image in whole.column(0):
                docs, starts, tokens, ids = read_image(image.as_buffer().to_pybytes(), table)
                stops = np.cumsum(tokens).tolist()
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array([0, *stops], pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    images = spark.read.schema("shard int, seq int, image binary").parquet(f"{path}/images")
    return images.select("image").mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
