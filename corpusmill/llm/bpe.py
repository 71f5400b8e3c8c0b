"""Byte-pair encoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged, so the text may be cut
there and the pieces encoded on their own. The forced pairs are read from the vocabulary, all of them are used, and
two steps make the pieces:

* text is cut where a byte that isn't ASCII white space comes before ASCII white space (a pre-token of the
  tokenizer's pattern never runs into white space that follows it, and the pattern's only look-ahead is about what
  follows white space); bytes that some token does have before white space are not cut after;
* each distinct piece of over SHORT bytes is cut at every other forced pair that lies between two characters, unless the pattern might
  see the parts otherwise than the whole: behind white space (the look-ahead), and beside an apostrophe
  (contractions). Elsewhere a cut is either a border of pre-tokens already or parts a run of one class of
  characters, whose second part is a run of its own.

Pieces repeat, so each distinct piece is encoded once and kept in a bounded memo; ids of a text are the
concatenation of its pieces' ids.

Where only ids are wanted (packing), whole texts are merged by tiktoken's core, without pieces and memo.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Fixed: the split pattern of byte-level BPE tokenizers of this family (public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in memory by one Python worker; when full, the memo starts anew (a bound on memory alone).
MEMO_PIECES = 600_000
#: Longer pieces aren't kept; pieces up to SHORT bytes (words, as a rule) are merged whole.
MEMO_BYTES, SHORT = 64, 32
#: Characters of white space in a row that are merged apart: some hundred thousand overflow the stack of tiktoken's regular expressions.
LONG_SPACE = 50_000
#: Fixed: the pattern's \s, which is Unicode's White_Space.
LONG_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
#: Fixed: the letters of the pattern's contractions of more than one letter.
CONTRACTIONS = (b"re", b"ve", b"ll")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: Latin-1's printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Encodes and decodes as the tokenizers library does for a byte-level BPE file with the pattern above, without added special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        vocab = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        joined = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in joined]
        if made != sorted(made):
            raise ValueError("merge order and token ids disagree; this encoder ranks merges by id")
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        inside = {t[i : i + 2] for t in vocab for i in range(len(t) - 1)}
        space = b" \t\n\r"
        #: Bytes that some token has before white space; after those, white space is no certain cut.
        joined_to_space = bytes(b for b in range(256) if b not in space and any(bytes((b, x)) in inside for x in space))
        tail = b"(?:(?<=[%s])[ \t\n\r]+[^ \t\n\r]*)*" % re.escape(joined_to_space) if joined_to_space else b""
        #: Cuts UTF-8 text before white space.
        self.pieces = re.compile(b"[ \t\n\r]*[^ \t\n\r]+%s|[ \t\n\r]+" % tail, re.DOTALL).findall
        #: Whether a byte pair is forced: in no token, so that no merge joins it.
        self.forced = np.ones((256, 256), bool)
        for pair in [*inside, *CONTRACTIONS]:
            self.forced[pair[0], pair[1]] = False
        self.special = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}

    def _new(self, key: bytes) -> tuple[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) and decoded bytes of a piece not yet in the memo."""
        if len(key) <= SHORT:  # cutting costs more than it saves
            ids = self.bpe.encode_ordinary(key.decode())
        else:
            ids = []
            for fragment in self.fragments(key):
                ids += self.ordinary(fragment)
        out = _packed(ids), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(key) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[key] = out
        return out

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text without added tokens. Long white space is merged on its own: the pattern takes all of it as one pre-token, less its last character if something follows."""
        if len(text) < LONG_SPACE:
            return self.bpe.encode_ordinary(text)
        ids, at = [], 0
        for m in LONG_SPACES.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at : m.start()])
            ids += self.bpe._encode_single_piece(text[m.start() : end])
            at = end
        return ids + self.bpe.encode_ordinary(text[at:])

    def ids(self, text: str) -> bytes:
        """All ids of the text as little-endian unsigned 32-bit integers, as encode_bytes, merged whole."""
        return b"".join([_packed([self.added[part]] if special else self.ordinary(part)) for part, special in self._spans(text)])

    def fragments(self, piece: bytes) -> list[str]:
        """A piece cut at its forced pairs."""
        b = np.frombuffer(piece, np.uint8)
        left, right = b[:-1], b[1:]
        cut = np.flatnonzero(self.forced[left, right] & (right & 0xC0 != 0x80) & (left != 39) & (right != 39)) + 1
        out, held = [], ""
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(piece)], strict=True):
            held += piece[i:j].decode()
            if not held[-1:].isspace():
                out.append(held)
                held = ""
        return [*out, held] if held else out

    def _spans(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode_bytes(self, text: str) -> tuple[bytes, bytes]:
        """All ids of the text as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        got: list[tuple[bytes, bytes]] = []
        look, new = self.memo.get, self._new
        for part, special in self._spans(text):
            if special:
                got.append((np.array([self.added[part]], "<u4").tobytes(), part.encode()))
            else:
                got += [look(p) or new(p) for p in self.pieces(part.encode())]
        return b"".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, decoded string. A null text counts as empty; repeated rows are encoded each; no shuffle."""
    path = path or default_path()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            got = [enc.encode_bytes(t or "") for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x[0]) // 4 for x in got], dtype=np.int64)]).astype(np.int32)
            flat = np.frombuffer(b"".join(x[0] for x in got), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([x[1].decode("utf-8", "replace") for x in got], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(lean(run), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text; other columns are ignored).

    Null text: as empty, no tokens, the digests of nothing. Null doc_id and repeated rows pass through, one row
    out for each row in; an empty table gives an empty result. One narrow stage: nothing is shuffled or gathered.
    """
    path = path or default_path()

    def run(batches):
        sha = hashlib.sha256
        enc = encoder(path)
        for b in batches:
            n, ids, dec = [], [], []
            for t in b.column(1).to_pylist():
                i, d = enc.encode_bytes(t or "")
                n.append(len(i) // 4)
                ids.append(sha(i).hexdigest())
                dec.append(sha(d.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of at most `size` tokens; only the first may be shorter."""
    n = len(ids) // 4
    first = n % size or min(n, size)
    cuts = [0, *range(first, n, size), n] if n else [0]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]
