"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The library merges the adjacent pair whose joined piece scores highest, again and again.
The same result is found left to right: take the longest piece that matches (an
Aho-Corasick automaton yields all matches), keep it only if merging the last two pieces'
joined text again gives just those two pieces, else try the next shorter match, else mark
the position as failed in a bitfield and step back one piece. Adjacent compatibility
implies that the whole sequence is what merging would give, as each join is decided by
its two neighbours alone.

No piece holds a space mark behind another character, so the text falls into chunks (a
run of space marks and the word after it) that are encoded apart; results are cached by
chunk. That property is checked when the model is loaded, and without it each text is one
chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import pairwise
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tapeglass.llm.common import WordCache, arrow_map, tokenizer_path

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceEncoder:
    """Encodes text to the ids that the sentencepiece library gives for a BPE model with
    byte fallback, an identity normaliser and a leading space mark."""

    def __init__(self, model_file: str) -> None:
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[sp.id_to_piece(i)] = i
        if sp.normalize(" a  b　ﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b　ﬁ":
            raise ValueError("the model's normaliser is not the identity with a leading space mark")
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.split: dict[str, tuple[str, str]] = {}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_chunk = not any(inner.search(p) for p in self.ids)
        self.compatible = lru_cache(maxsize=300_000)(self._compatible)
        self.prefix: dict[str, str] = {}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts = WordCache(lambda part: [self.ids[p] for p in self.backtrack(part)])
        self.packed = WordCache(lambda chunk: pack("<%dI" % len(x := self.chunk_ids(chunk)), *x), limit=1_000_000)

    def merge(self, text: str, above: float = -float("inf")) -> list[str]:
        """Merging as the library does it: best score first, leftmost among equals. Only
        merges that score higher than ``above`` are made."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(part[a] + part[b])) is not None and s > above:
                heapq.heappush(heap, (-s, a, b, len(part[a]) + len(part[b])))

        for a, b in pairwise(range(len(part))):
            offer(a, b)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not part[a] or not part[b] or right[a] != b or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge, the last one, gives ``piece``."""
        found = self.split.get(piece)
        if found is None:
            found = self.split[piece] = tuple(self.merge(piece, above=self.score[piece]))
        return found

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of ``a`` and ``b`` gives just these two pieces.

        The merges of both are undone from the last on, and redone beside the seam: if the
        parts that then touch would merge across it before the undone merge (or, as ties go
        to the left, with it on the right side), merging gives something else."""
        score = self.score
        limit = -float("inf")  # a merge across the seam must not score above this
        while True:
            across = score.get(a + b)
            if across is not None and across > limit:
                return False
            last_a = score[a] if len(a) > 1 else float("inf")
            last_b = score[b] if len(b) > 1 else float("inf")
            if last_a < last_b:
                limit = last_a
                a = self.halves(a)[1]
            elif len(b) > 1:
                limit = np.nextafter(last_b, -np.inf)
                b = self.halves(b)[0]
            else:
                return True

    def shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix of ``piece``, else empty."""
        found = self.prefix.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), "")
            self.prefix[piece] = found
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of ``text``, all of whose characters are pieces."""
        n = len(text)
        longest = [1] * n
        for last, size in self.automaton.iter(text):  # ends ascend: a longer match from the same start comes later
            longest[last - size + 1] = size
        failed = 0  # bit i: no valid continuation from position i after any piece tried so far
        compatible = self.compatible
        out: list[str] = []
        at, before, piece = 0, "", text[: longest[0]]
        while True:
            while piece:
                end = at + len(piece)
                if not failed >> end & 1 and (not before or compatible(before, piece)):
                    break
                piece = self.shorter(piece)
            if piece:
                out.append(piece)
                if end == n:
                    return out
                at, before = end, piece
                piece = text[at : at + longest[at]]
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""
                piece = self.shorter(piece)

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one chunk. It is cut where two characters stand side by side that do so in
        no piece, as no merge crosses there; a character that is no piece becomes bytes."""
        ids, pairs = self.ids, self.pairs
        out: list[int] = []
        start = 0
        for i in range(1, len(chunk) + 1):
            if i < len(chunk) and chunk[i - 1 : i + 1] in pairs:
                continue
            part = chunk[start:i]
            start = i
            if part in ids:
                out.append(ids[part])
            elif len(part) == 1:
                out += [self.bytes[b] for b in part.encode("utf-8")]
            else:
                out += self.parts[part]
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_chunk:
            return self.packed[marked]
        return b"".join(map(self.packed.__getitem__, CHUNK.findall(marked)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    Ids carry the model's begin and end ids; the decoded text is what the library's
    decode(ids) gives. Null and empty text: begin and end alone, decoded to the empty
    string. Repeated rows each give a row; other columns are not read. One pass, no shuffle.
    """
    model_file = model_file or tokenizer_path("piece_bpe_32k.model")

    def make():
        enc = PieceEncoder(model_file)
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (enc.bos, enc.eos))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [begin + enc.encode_packed(t or "") + end for t in batch.column("text").to_pylist()]
            decoded = (enc.model.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for d in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=256)
