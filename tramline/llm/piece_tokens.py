"""Encoding and decoding with a public merge-type piece vocabulary, by a prefix table.

A text splits before each run of space marks and around characters that no piece holds; no merge can cross
there, which the vocabulary is checked for. In such a segment, an automaton gives the pieces that end at each position.
The encoding of a prefix has one last piece: the one whose own start has a last piece that it is compatible with. Two
neighbours are compatible if undoing their merges, latest first, never shows a pair across their border that would have merged
before. The table of last pieces is filled from left to right, and the ids are read from it from right to left.

Pieces that share a rank with one of their parts (runs of space marks) break the order that this needs;
a segment that holds one is merged pair by pair instead.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_workers, pick

MARK = "▁"
#: Segments and pairs remembered by a task, and the longest segment that is.
REMEMBERED, LONGEST = 400_000, 48


class PieceTokenizer:
    """ids and back, as the library that the vocabulary file is for does without begin, end or sampling."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)  # reads the vocabulary; encodes nothing
        self.n = n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_of = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if i not in special and i not in self.byte_of and not sp.is_unused(i)]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id_of = {p: i for i, p in self.piece.items()}
        #: Lower merges first; equal scores rank alike.
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.id_of.items()}
        self.special = special
        self.special_text = {i: " ⁇ " for i in special if sp.is_unknown(i)}
        chars = set("".join(p for p in self.id_of))
        self.known = {c for c in self.id_of if len(c) == 1}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of) or sp.normalize("A  b ") != f"{MARK}A{MARK}{MARK}b ":
            raise ValueError("this vocabulary joins words, or its normaliser changes texts")
        self._split: dict[str, tuple[str, str] | None] = {}
        self._odd: set[str] = set()
        reached = [p for p in self.id_of if len(p) == 1]
        automaton = ahocorasick.Automaton()
        for p in sorted((p for p in self.id_of if len(p) > 1), key=len):
            parts = self._merge(p, keep=2)
            if parts is None:
                continue  # never comes out of its own characters
            self._split[p] = parts
            if any(len(x) > 1 and self.rank[x] >= self.rank[p] for x in parts):
                self._odd.add(p)
            reached.append(p)
        for p in reached:
            automaton.add_word(p, (self.id_of[p], 0 if p in self._odd else len(p)))
        automaton.make_automaton()
        self._automaton = automaton
        self.lines = "\n" not in chars  # then nothing merges across the end of a line
        self._segments = re.compile(rf"\n+|{MARK}*[^{MARK}\n]+|{MARK}+" if self.lines else rf"{MARK}*[^{MARK}]+|{MARK}+").findall
        self._pairs: dict[int, bool] = {}

    def _merge(self, text: str, keep: int = 0):
        """Merge best pairs first, leftmost among equals. keep=2: the two parts of the last merge, or None if it doesn't reach one piece."""
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (r := self.rank.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        last = None
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != joined:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = [p for p in parts if p is not None]
        if keep:
            return last if len(out) == 1 else None
        return out

    def _fits(self, left_id: int, right_id: int) -> bool:
        """Whether the two stay apart: no pair across the border merges before the pieces around it are whole."""
        rank, left, right = self.rank, self.piece[left_id], self.piece[right_id]
        limit = 1 << 60  # a pair across the border that ranks below it would have merged
        while True:
            r = rank.get(left + right)
            if r is not None and r < limit:
                fits = False
                break
            a = rank[left] if len(left) > 1 else -1
            b = rank[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                fits = True
                break
            if a > b:  # the later merge is undone first; of equal ones the right
                limit, left = a, self._split[left][1]
            else:
                limit, right = b + 1, self._split[right][0]
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        self._pairs[left_id << 20 | right_id] = fits
        return fits

    def _known(self, text: str) -> list[int]:
        """ids of a text whose characters are all pieces."""
        n = len(text)
        table = [-1] * (n + 1)
        pairs, fits = self._pairs.get, self._fits
        for end, (i, size) in self._automaton.iter(text):
            if not size:  # breaks the order of ranks
                break
            if table[end + 1] < 0:
                if end + 1 == size:
                    table[size] = i
                elif (q := table[end + 1 - size]) >= 0:
                    ok = pairs(q << 20 | i)
                    if fits(q, i) if ok is None else ok:
                        table[end + 1] = i
        else:
            out, at, piece = [], n, self.piece
            while at and (i := table[at]) >= 0:
                out.append(i)
                at -= len(piece[i])
            if not at:
                out.reverse()
                return out
        return [self.id_of[p] for p in self._merge(text)]

    def segment(self, text: str) -> list[int]:
        """ids of what pieces_of() gives."""
        try:
            return self._known(text) if self.known.issuperset(text) else self._mixed(text)
        except KeyError:  # a lone surrogate has no UTF-8
            return self._mixed(text)

    def _mixed(self, text: str) -> list[int]:
        out: list[int] = []
        known, start = self.known, 0
        for at, c in enumerate(text):
            if c not in known:
                if start < at:
                    out.extend(self._known(text[start:at]))
                out.extend(self.id_of_byte[b] for b in c.encode("utf-8", "replace"))
                start = at + 1
        if start < len(text):
            out.extend(self._known(text[start:]))
        return out

    def pieces_of(self, text: str) -> list[str]:
        """The segments of a text, which are encoded one by one."""
        return self._segments((MARK + text).replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.pieces_of(text) for i in self.segment(s)]

    def bytes_of(self, i: int) -> bytes:
        if (b := self.byte_of.get(i)) is not None:
            return bytes((b,))
        return (self.special_text.get(i, "") if i in self.special else self.piece[i].replace(MARK, " ")).encode()

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """The text of ids; one space that the first piece begins with is the mark that encoding puts there. Bytes that are no UTF-8 become U+FFFD each."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.special:
                out.append(self.special_text.get(i, ""))
                first = first and i not in self.special_text
            else:
                p = self.piece[i]
                out.append((p[1:] if first and p[0] == MARK else p).replace(MARK, " "))
                first = False
        out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(run: bytes) -> str:
    """Decoded, with one U+FFFD for each byte of what is not UTF-8."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Encoded:
    """Decimal ids joined by commas, and the text decoded from these, of whole texts. Words are remembered with their ids in two generations."""

    def __init__(self, tok: PieceTokenizer):
        self.tok = tok
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.line_end = ",".join(map(str, tok.segment("\n"))) if tok.lines else ""
        # bytes from 128 on stand as lone surrogates until all of a text's bytes are decoded together
        texts = {i: p.replace(MARK, " ") for i, p in tok.piece.items()} | {i: bytes((b,)).decode("ascii", "surrogateescape") for i, b in tok.byte_of.items()}
        self.text_of = {str(i): t for i, t in texts.items()}.__getitem__
        self.marked = {str(i) for i, p in tok.piece.items() if p[0] == MARK}

    def look(self, key: str) -> str:
        """ids of a key: a word after a space, or one that begins a line after an end of line."""
        if (x := self.old.get(key)) is None:
            x = ",".join(map(str, self.tok.segment(key[1:] if key[0] == "\n" else MARK + key)))
            if len(key) > LONGEST:
                return x
        if len(self.new) >= REMEMBERED:
            self.new, self.old = {}, self.new
        self.new[key] = x
        return x

    def decoded(self, decimal: str) -> str:
        """tok.decode() of the ids."""
        ids = decimal.split(",") if decimal else []
        try:
            text = "".join(map(self.text_of, ids)).encode("utf-8", "surrogateescape").decode()
        except (KeyError, UnicodeError):  # other ids than of pieces and bytes, or bytes that are no UTF-8
            return self.tok.decode([int(i) for i in ids])
        return text[1:] if ids and ids[0] in self.marked else text

    def __call__(self, text: str) -> tuple[str, str]:
        decimal = self.ids(text)
        return decimal, self.decoded(decimal)

    def ids(self, text: str) -> str:
        found: list[str] = []
        if text and (not self.tok.lines or MARK in text):
            return ",".join(map(str, self.tok.encode(text)))
        for k, line in enumerate(text.split("\n") if text else ()):
            keys = line.split(" ")
            if k:
                found.append(self.line_end)
                keys[0] = "\n" + keys[0]
            if "" in keys or keys[0] == "\n":  # spaces in a row, or at an end of the line
                found += [",".join(map(str, self.tok.segment(s))) for s in self.tok._segments(("" if k else MARK) + line.replace(" ", MARK))]
                continue
            known = list(map(self.new.get, keys))
            if None in known:
                known = [self.look(s) if x is None else x for s, x in zip(keys, known, strict=True)]
            found += known
        return ",".join(found)


_loaded: dict[str, PieceTokenizer] = {}


def tokenizer(model_path: str) -> PieceTokenizer:
    """One of each path in a Python worker."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceTokenizer(model_path)
        gc.collect()
        gc.freeze()  # the vocabulary stays; later collections needn't visit it
    return _loaded[model_path]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8. A null text counts as empty: no ids,
    an empty decoded text. Repeated rows give repeated rows. Other columns are ignored. Texts are taken batch by batch.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = Encoded(tokenizer(model_path))
        for batch in batches:
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for text in batch.column(1):
                decimal, decoded = encoded(text.as_py() or "")
                n.append(decimal.count(",") + 1 if decimal else 0)
                ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in decimal.split(",")] if decimal else [])
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    rows = pick(docs, "doc_id", "text")
    return on_workers(rows.select(rows["doc_id"].cast("long"), rows["text"].cast("string")), run, schema)
