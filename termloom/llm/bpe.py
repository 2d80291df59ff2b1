"""Byte-level BPE by backtracking over longest matches, and its inverse.

The tokens' bytes, read as Latin-1, are the words of a pyahocorasick automaton. A piece is encoded
from left to right with the longest token at each place; a token is kept only if it and the token
before it would stand side by side after the merges (memoised for each pair of tokens), else the
next shorter token is tried, and where none is left the last token is taken back. A place that was
once taken back is never entered again, so the work is linear in the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from termloom.llm.common import slices

#: Entries that each worker keeps of pieces, and of pairs of tokens, before it starts anew.
PIECES, PAIRS = 500_000, 1_000_000


class BpeCodec:
    """Encoder and decoder for one file of ranks (base64 token, blank, rank on each line)."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.token_bytes = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, lines))}
        self.ids = {token.decode("latin-1"): rank for rank, token in self.token_bytes.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made_by: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter = {rank: self._prefix(token) for token, rank in self.ids.items()}
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            self.parts[rank] = self._merge_of(token, rank)
            if self.parts[rank][0] != rank:
                self.made_by[self.parts[rank]] = rank
            self.pairs.clear()
        self.decimal = {str(rank): token for rank, token in self.token_bytes.items()}
        self.pieces = _Pieces(self)

    def _prefix(self, token: str) -> int | None:
        """The longest token that is a proper prefix of this one."""
        return next((self.ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), None)

    def _merge_of(self, token: str, rank: int) -> tuple[int, int]:
        """The two tokens of lower rank that merge to this one last; (rank, rank) if none do."""
        left = self.shorter[rank]
        while left is not None:
            right = self.ids.get(token[len(self.token_bytes[left]) :])
            if right is not None and left < rank and right < rank and self._stands(left, right):
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _stands(self, left: int, right: int) -> bool:
        """True if the merges leave left and right side by side: nothing merges across their border sooner."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._unmerged(left, right)
        return known

    def _unmerged(self, a: int, b: int) -> bool:
        """Undo merges beside the border, the later one first; a merge across it before that one refutes the pair."""
        undone = 1 << 62
        while True:
            if self.made_by.get((a, b), undone) < undone:
                return False
            if a > b:
                undone, inner = a, self.parts[a][1]
                if inner != a:
                    a = inner
                    continue
                undone, inner = b + 1, self.parts[b][0]
                if inner == b:
                    return True
                b = inner
            else:
                undone, inner = b + 1, self.parts[b][0]
                if inner != b:
                    b = inner
                    continue
                undone, inner = a, self.parts[a][1]
                if inner == a:
                    return True
                a = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        if (whole := self.ids.get(text)) is not None:
            return [whole]
        n = len(text)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, found in self.automaton.iter(text):
            start = end - found[0] + 1
            if found[0] > longest[start][0]:
                longest[start] = found
        open_at, out, at = bytearray(b"\x01") * (n + 1), [], 0
        token = longest[0][1]
        while True:
            size = len(self.token_bytes[token])
            if open_at[at + size] and (not out or self._stands(out[-1], token)):
                out.append(token)
                at += size
                if at == n:
                    return out
                token = longest[at][1]
                continue
            if (less := self.shorter[token]) is not None:
                token = less
                continue
            open_at[at] = 0
            if not out:
                raise ValueError("the ranks cannot spell this piece")
            token = out.pop()
            at -= len(self.token_bytes[token])

    def encode(self, text: str) -> list[int]:
        """The ids of a text; each match of the pattern by itself."""
        csv = self.encode_csv(text)
        return list(map(int, csv.split(","))) if csv else []

    def encode_csv(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        return ",".join(map(self.pieces.__getitem__, self.find(text)))

    def decode_csv(self, csv: str) -> bytes:
        return b"".join(map(self.decimal.__getitem__, csv.split(","))) if csv else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class _Pieces(dict):
    """Piece to its ids in decimal, joined by commas."""

    def __init__(self, codec: BpeCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        csv = ",".join(map(str, self.codec.encode_piece(piece.encode("utf-8"))))
        if len(piece) <= 64:
            self[piece] = csv
        return csv


_codecs: dict[tuple[str, str], BpeCodec] = {}


def codec(ranks_path: str, pattern: str) -> BpeCodec:
    """One codec for each worker process; the vocabulary file is part of every machine's installed library."""
    if (ranks_path, pattern) not in _codecs:
        with open(ranks_path, "rb") as f:
            _codecs[ranks_path, pattern] = BpeCodec(f.read().split(b"\n"), pattern)
    return _codecs[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode text_col of every row: id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    A null or empty text has no ids: 0, sha256 of nothing twice, an empty list. Rows stay one to one, in
    whatever order, whether ids repeat or are null; other columns, whatever their names, aren't read.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                n, enc, dec, lists = [], [], [], []
                for text in texts:
                    csv = own.encode_csv(text.as_py() or "")
                    n.append(csv.count(",") + 1 if csv else 0)
                    enc.append(sha(csv.encode()))
                    dec.append(sha(own.decode_csv(csv)))
                    if ids:
                        lists.append(list(map(int, csv.split(","))) if csv else [])
                cols = [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
