"""Byte-pair encoding and decoding.

Words are worked out once and kept in a bounded cache. The new ones of some texts are merged together, as rows of a
matrix of symbols: each round does in each row the merge of lowest rank, the leftmost among equals. In a long piece
merges are taken from a priority queue of ranks over a doubly linked list of symbols; entries that an earlier merge has
made stale are skipped. Decoding joins vocabulary strings.

The vocabulary files are those of the ``tokenizers`` library; two kinds are understood:

* word-end BPE: NFC, white space collapsed, lower case, pieces by a regular expression, ``</w>`` on
  each piece's last symbol, and no decoder (tokens are joined by spaces);
* byte-level BPE, where white space belongs to the pieces.

Edge cases: a null text counts as empty and gives no ids and an empty decoded text; texts of any
length are encoded whole; repeated rows give repeated results; an empty table gives an empty one;
only the id and text columns are read, so further columns can have any name.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, claim, on_release, public_vocabulary, read_vocabulary, table, text_or_empty

WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers of Unicode 17, which the tokenizers library's expressions (Unicode 16) don't know as such.
_NEW_LETTERS = "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
_NEW_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Lower case that came with Unicode 16 and 17, which Python's str.lower() doesn't know.
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)} | {ord("Σ"): ord("σ")}
_HAS_NEW_LOWER = re.compile(f"[{''.join(map(chr, _NEW_LOWER))}]")


def _without(kind: str, new: str) -> str:
    return f"[\\p{{{kind}}}--[{''.join('-'.join(chr(int(c, 16)) for c in x.split('-')) for x in new.split())}]]"


_L, _N = _without("L", _NEW_LETTERS), _without("N", _NEW_NUMBERS)
_OTHER = f"[^{WHITE}{_L}{_N}]"
_WORD = regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|{_OTHER}+")
#: The same over words with blanks between, which it finds as well.
_WORDS = regex.compile(f"{_WORD.pattern}| ")
_BYTE = regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_OTHER}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_SPLIT = regex.compile(f"[{WHITE}]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: White space next to a blank; without it, every blank starts a piece.
_RUN = regex.compile(rf" [{WHITE}\x1c-\x1f]|[{WHITE}\x1c-\x1f] ")
#: Entries of a worker's cache, which is emptied when full, and the longest text that is kept in it.
CACHE, CACHED_LENGTH = 1 << 17, 64
#: Bytes up to which pieces are merged as rows of one matrix, its most rows, the rank of pairs without a merge, and the texts that are encoded together.
WIDTHS, ROWS, NONE, TEXTS = (1, 4, 8, 12, 16, 24, 32, 64), 1 << 14, np.iinfo(np.int32).max, 512


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class _Chunks(dict):
    """What belongs to a chunk of text, worked out when first asked for.

    Bounded: a full cache becomes the old generation, from which what is still in use moves over.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: str):
        out = self.old.get(chunk)
        if out is None:
            out = self.make(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out


class _Known:
    """Ids of words, bounded as ``_Chunks`` is, but asked for and worked out many at a time."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def lacking(self, words: set[str]) -> list[str]:
        """Those that aren't known; ``now`` has all others afterwards."""
        new = words.difference(self.now)
        self.now.update({w: self.old[w] for w in new if w in self.old})
        return [w for w in new if w not in self.old]

    def add(self, words: list[str], ids: list[bytes]) -> None:
        self.now.update(zip(words, ids))
        self.long += [w for w in words if len(w) > CACHED_LENGTH]

    def shed(self) -> None:
        """Between texts: long words go, and a full generation becomes the old one."""
        for w in self.long:
            self.now.pop(w, None)
        self.long = []
        if len(self.now) >= CACHE:
            self.now, self.old = {}, self.now


class Bpe:
    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = (tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in model["merges"])
        self.merges = [(self.vocab[x], self.vocab[y], self.vocab[x + y]) for x, y in pairs]
        self.rank_of = {x << 32 | y: rank for rank, (x, y, _) in enumerate(self.merges)}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in chain(self.vocab.items(), self.special.items()):
            self.tokens[i] = token
        byte = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(byte)}
        self.first_ids = [self.vocab[c] for c in byte]
        self.last_ids = [self.vocab[c + self.suffix] for c in byte]
        pairs = sorted(self.rank_of)
        self.pairs = np.array([*pairs, np.iinfo(np.int64).max])
        self.pair_ranks = np.array([*map(self.rank_of.__getitem__, pairs), NONE], np.int32)
        self.merged = np.array([both for _, _, both in self.merges], np.int32)
        self.first, self.last = np.array(self.first_ids, np.int32), np.array(self.last_ids, np.int32)
        self.inner_ranks, self.end_ranks = (self.ranks(self.first[:, None], x[None, :]) for x in (self.first, self.last))
        self.joined = spec["decoder"] is None
        self.by_words = bool(self.suffix)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known_chunks = _Known()
        # a word's pieces are such words themselves
        self.known_pieces = self.known_chunks if self.by_words else _Known()

    def merge(self, symbols: list[int]) -> int:
        """Does all merges, lowest rank first and leftmost first among equals, and gives their number; -1 stands for what has gone.

        A queue entry is one integer, the rank above the position of the left symbol.
        """
        done = 0
        n, rank_of, merges = len(symbols), self.rank_of.get, self.merges
        queue = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not queue:
            return 0
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            left, right, both = merges[entry >> 32]
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            symbols[i] = both
            symbols[j] = -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(both << 32 | symbols[k])) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] << 32 | both)) is not None:
                heappush(queue, rank << 32 | h)
        return done

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a right of -1 is none."""
        keys = left.astype(np.int64) << 32 | right
        at = self.pairs.searchsorted(keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NONE)

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """``piece_ids`` of many pieces."""
        data, out, least = [p.encode() for p in pieces], [b""] * len(pieces), 0
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for i in range(0, len(rows), ROWS):
                self.merge_rows(data, rows[i : i + ROWS], sizes[rows[i : i + ROWS]], width, out)
        for i in np.flatnonzero(sizes > least).tolist():
            out[i] = self.piece_ids(pieces[i])
        return out

    def merge_rows(self, data: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        """Does all merges of the pieces ``rows`` of ``data``, one of each piece in a round, and puts their ids into ``out``."""
        raw = np.frombuffer(b"".join([data[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
        each, columns, end = np.arange(len(rows)), np.arange(width), sizes - 1
        last = raw[each, end]
        symbols = np.where(columns < end[:, None], self.first[raw], np.int32(-1))
        symbols[each, end] = self.last[last]
        # the rank of each symbol with the next
        ranks = np.full(raw.shape, NONE, np.int32)
        ranks[:, :-1] = np.where(columns[1:] < end[:, None], self.inner_ranks[raw[:, :-1], raw[:, 1:]], NONE)
        two = np.flatnonzero(end)
        ranks[two, end[two] - 1] = self.end_ranks[raw[two, end[two] - 1], last[two]]
        while len(rows):
            at = ranks.argmin(1)
            rank = ranks[each, at]
            done = rank == NONE
            if done.any():
                ids = symbols[done][columns < sizes[done, None]].astype("<u4").tobytes()
                ends = (4 * sizes[done].cumsum()).tolist()
                for i, a, b in zip(rows[done].tolist(), [0, *ends], ends):
                    out[i] = ids[a:b]
                go = ~done
                rows, sizes, symbols, ranks, at, rank = (x[go] for x in (rows, sizes, symbols, ranks, at, rank))
                each = each[: len(rows)]
                if not len(rows):
                    break
            sizes, columns = sizes - 1, columns[:-1]
            symbols = np.where(columns <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            ranks = np.where(columns < at[:, None], ranks[:, :-1], ranks[:, 1:])
            both = symbols[each, at] = self.merged[rank]
            right = np.flatnonzero(at + 1 < sizes)
            ranks[each, at] = NONE
            ranks[right, at[right]] = self.ranks(both[right], symbols[right, at[right] + 1])
            left = np.flatnonzero(at)
            ranks[left, at[left] - 1] = self.ranks(symbols[left, at[left] - 1], both[left])

    def symbols(self, piece: str) -> list[int]:
        data = piece.encode()
        return [*map(self.first_ids.__getitem__, data[:-1]), self.last_ids[data[-1]]]

    def piece_ids(self, piece: str) -> bytes:
        symbols = self.symbols(piece)
        return array("I", [s for s in symbols if s >= 0] if self.merge(symbols) else symbols).tobytes()

    def piece_count(self, piece: str) -> int:
        """Number of the piece's tokens."""
        symbols = self.symbols(piece)
        return len(symbols) - self.merge(symbols)

    def pieces(self, chunk: str) -> list[str]:
        return _WORD.findall(self.normal(chunk)) if self.by_words else _BYTE.findall(chunk)

    def normal(self, text: str) -> str:
        """What is split into pieces: no character of it depends on those beyond a blank."""
        if self.by_words and not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _HAS_NEW_LOWER.search(text):
                text = text.translate(_NEW_LOWER)
        return text.lower() if self.by_words else text

    def split(self, text: str) -> list[str]:
        """Chunks, none of which shares a piece with another."""
        if self.by_words:
            return text.split() if not _ODD_SPACE.search(text) else [x for x in _SPLIT.split(text) if x]
        if " " not in text or _RUN.search(text):
            return _BYTE.findall(text)
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        return [first, *out] if first else out

    def plain(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, and the id of each special token."""
        if self.specials is None or not self.specials.search(text):
            yield text, None
            return
        at = 0
        for m in self.specials.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks."""
        new = self.known_chunks.lacking(chunks)
        mark, end = " " if self.by_words else "", b"\xff" * 4  # no bytes of ids, as their highest is 0
        for i in range(0, len(new), ROWS):
            part = new[i : i + ROWS]
            words = self.normal(" ".join(part)).split(" ") if self.by_words else part
            odd = [w for w in words if not w.isalpha()]  # else a word is one piece: what Python takes for letters, the expressions do
            pieces = _WORDS.findall(" ".join(odd)) if self.by_words else [p for w in odd for p in (*_BYTE.findall(w), mark)][:-1]
            lacking = self.known_pieces.lacking({*(w for w in words if w.isalpha()), *pieces} - {mark})
            self.known_pieces.add(lacking, self.pieces_ids(lacking))
            ids = self.known_pieces.now
            ids[mark] = end
            of_odd = iter(b"".join(map(ids.__getitem__, pieces)).split(end))
            found = [ids[w] if w.isalpha() else next(of_odd) for w in words]
            del ids[mark]
            self.known_chunks.add(part, found)
        return self.known_chunks.now

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [[self.split(part) if special is None else special.to_bytes(4, "little") for part, special in self.plain(t)] for t in texts]
        ids = self.learn(set().union(*(x for text in parts for x in text if isinstance(x, list)))).__getitem__
        out = [b"".join([b"".join(map(ids, x)) if isinstance(x, list) else x for x in text]) for text in parts]
        self.known_chunks.shed()
        self.known_pieces.shed()
        return out

    def encode_packed(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Joins the vocabulary strings of ``ids``; special tokens stay."""
        strings = map(self.tokens.__getitem__, ids)
        if self.joined:
            return " ".join(strings)
        out = bytearray()
        for s in strings:
            out += bytes(map(self.bytes_of.__getitem__, s)) if all(c in self.bytes_of for c in s) else s.encode()
        return out.decode(errors="replace")


_LOADED: dict[int, Bpe] = {}
on_release(_LOADED.clear)


def loaded(data: bytes) -> Bpe:
    """One codec a worker for each vocabulary."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = Bpe(data)
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Per row: the id column, ``n_tokens``, ``ids`` and ``decoded``.

    ``ids`` is an array of integers, or with ``packed`` the same as little-endian unsigned 32-bit binary.
    A row-wise operator: no shuffle, one Arrow batch in memory at a time.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or public_vocabulary("word_bpe_49k.json")))
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        codec = loaded(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                data = codec.encode_all(part.column(1).to_pylist())
                ids = [np.frombuffer(x, "<u4").tolist() for x in data]
                stored = pa.array(data, pa.binary()) if packed else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), stored, pa.array([codec.decode(x) for x in ids], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    out = source.mapInArrow(run, f"id {id_type}, n_tokens bigint, ids {'binary' if packed else 'array<int>'}, decoded string")
    return out.withColumnRenamed("id", id_col)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), packed=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
