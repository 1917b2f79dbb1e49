"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

A rank file (token bytes in base64, rank) becomes a tokenizers BPE model: every byte is mapped to a
printable character, and each split of a token into two known tokens becomes a merge at the token's rank.
The text is cut by the pre-token pattern first and each piece is encoded by itself, so pieces seen before
come from a bounded cache; the library sees only distinct misses of a batch.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

CACHE_PIECES = 400_000
CACHED_LENGTH = 48
_LONG_TEXT = 4_000_000


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1's printable ones stand for themselves, the others follow
    from U+0100 on."""
    own = set([*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)])
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Splitter:
    """The pieces of a text by a pattern, with letters and numbers as the rank library's Unicode tables have
    them: code points that only newer tables call letters or numbers are taken out of those classes."""

    def __init__(self, pattern: str):
        import tiktoken

        lead = sorted({chr(c).encode()[:1] for c in (*range(0x80, 0xD800, 64), *range(0xE000, 0x110000, 64))})
        ranks = {bytes([b]): b for b in range(256)} | {x + b: 256 + i for i, (x, b) in enumerate((x, b) for x in (b"a", b"1") for b in lead)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
        doubtful = [("a", c) for c in regex.findall(r"\p{L}", unassigned)] + [("1", c) for c in regex.findall(r"\p{N}", unassigned)]
        newer = [c for like, c in doubtful if len(probe.encode_ordinary(like + c)) == 1 + len(c.encode())]
        self.pattern, self.newer, self.careful = regex.compile(pattern), None, None
        self.latin = self._latin(pattern)
        if newer:
            some = "[" + "".join(newer) + "]"
            self.newer = regex.compile(some)
            classes = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|" + some + ")")
            self.careful = regex.compile(regex.sub(r"(?<!\[\^\\s)(?<!\})\\p\{([LN])\}", lambda m: f"(?:(?!{some})\\p{{{m[1]}}})", classes))

    @staticmethod
    def _latin(pattern: str) -> "re.Pattern | None":
        """The pattern for texts of Latin-1 characters alone, its classes spelled out for the faster engine; None if
        it uses more than letters, numbers and white space."""
        first = "".join(map(chr, range(256)))
        spelled = pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            members = "".join(map(re.escape, regex.findall(name, first)))
            inside = regex.compile(r"(\[\^[^\]]*?)" + re.escape(name))
            while inside.search(spelled):
                spelled = inside.sub(lambda m, x=members: m[1] + x, spelled, count=1)
            spelled = regex.sub(r"\\S", lambda _: "\x00", spelled).replace(name, f"[{members}]") if name == r"\s" else spelled.replace(name, f"[{members}]")
            if name == r"\s":
                spelled = spelled.replace("\x00", f"[^{members}]")
        try:
            return None if r"\p" in spelled else re.compile(spelled)
        except re.error:
            return None

    def __call__(self, text: str) -> "regex.Pattern":
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.careful if self.newer is not None and self.newer.search(text) else self.pattern
        return self.latin or self.pattern


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        ranks = read_ranks(path)
        self.char_of = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.char_of)}
        self.latin = {b: c for b, c in enumerate(self.char_of)}
        mapped = {token: self._mapped(token) for token in ranks}
        merges = [(rank, ranks[token[:i]], mapped[token[:i]], mapped[token[i:]]) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges.sort(key=lambda m: m[:2])
        self.library = Tokenizer(models.BPE(vocab={mapped[t]: r for t, r in ranks.items()}, merges=[m[2:] for m in merges], ignore_merges=True))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for text, rank in self.library.get_vocab().items():
            self.bytes_of[rank] = bytes(map(self.byte_of.__getitem__, text))
        self.split = _Splitter(pattern)
        self.cache: dict[str, bytes] = {}

    def _mapped(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.latin)

    def _ids_of(self, pieces: list[str]) -> bytes:
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        missing = [p for p in set(pieces) if p not in cache]
        if len(cache) + len(missing) > CACHE_PIECES:
            cache.clear()
            missing = list(set(pieces))
        found = self.library.encode_batch([self._mapped(p.encode("utf-8", "surrogatepass")) for p in missing], add_special_tokens=False)
        for piece, e in zip(missing, found, strict=True):
            ids = e.ids
            cache[piece] = pack("<%dI" % len(ids), *ids)
        out = b"".join(map(cache.__getitem__, pieces))
        for piece in missing:
            if len(piece) > CACHED_LENGTH:
                del cache[piece]
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's pieces in lists of bounded length."""
        pattern = self.split(text)
        if len(text) <= _LONG_TEXT:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while some := list(islice(found, 500_000)):
            yield some

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        return b"".join(map(self._ids_of, self.pieces(text or "")))

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of ids; a character whose bytes are split over tokens is put together again, and bytes that
        are no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes whole, token by token; a split character appears with its last token."""
        joined = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield joined.decode(self.bytes_of[i])
        yield joined.decode(b"", True)

    def offsets(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, end) of each token, in characters of the text; a token that holds part of a character
        spans that whole character."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        ids = np.frombuffer(self.encode(text), "<u4")
        ends = np.cumsum(np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), np.int64, len(ids)))
        starts = np.r_[np.zeros(min(1, len(ends)), np.int64), ends[:-1]]
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        at = np.cumsum(lead)
        return ids, (at[starts] - 1 if len(ids) else starts), (at[ends - 1] if len(ids) else ends)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker and rank file."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, with_ids also ids array<int> and
    the tokens' character offsets.

    Null texts are empty: no tokens, the digests of nothing. Rows keep their number and repeats; an empty table
    gives no rows. No shuffle.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path, pattern)
        rows: list[tuple] = []
        for text in batch.column(1):
            ids = bpe.encode(text.as_py())
            row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            if with_ids:
                numbers, starts, ends = bpe.offsets(text.as_py())
                row += (numbers.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32))
            rows.append(row)
        columns = list(zip(*rows, strict=True)) if rows else [()] * (6 if with_ids else 3)
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * 3]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        return pa.record_batch([batch.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "starts", "ends"][: 1 + len(arrays)])

    more = ", ids array<int>, starts array<int>, ends array<int>" if with_ids else ""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}", of)
