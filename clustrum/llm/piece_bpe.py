"""Exact merge-type (BPE) SentencePiece encoding by backtracking over longest matches, and decoding.

A sequence of pieces is what merging gives if every adjacent two of them are what merging their joined text gives. So
the encoder takes the longest piece that matches (Aho-Corasick finds all matches of a run in one pass), checks it
against the piece before by merging the two texts again, tries shorter pieces if the check fails, and steps back where
none is left; a bitfield holds the positions from which that has failed, so none is tried twice.

No piece of the model has a blank mark after another character, so texts are cut before each run of blank marks and
the runs of a worker's texts are remembered in two bounded tables.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .shared import FileBytes, read_table, ship, worker_model

MARK = "▁"
#: Runs, and pairs of pieces, that a table of a worker holds.
RUNS, PAIRS = 250_000, 300_000

_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceEncoder:
    """The ids of a SentencePiece model of merge type without normalisation rules, user-defined or unused pieces."""

    def __init__(self, raw: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        rules = model.normalizer_spec
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if model.trainer_spec.model_type != 2 or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only merge-type models without normalisation rules and user-defined pieces are encoded")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.unknown = model.trainer_spec.unk_id
        self.score, self.id, self.bytes = {}, {}, {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.score[p.piece], self.id[p.piece] = p.score, i
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.cut_at_marks = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.letters = {c for p in self.id for c in p}
        #: Merged pieces of one score: the pairwise check can't order those merges, so runs with them are merged.
        often = Counter(s for p, s in self.score.items() if len(p) > 1)
        tied = [p for p, s in self.score.items() if len(p) > 1 and often[s] > 1]
        self.tied = [p for p in tied if not any(q != p and q in p for q in tied)]
        self.automaton = ahocorasick.Automaton()
        for c in self.letters:
            self.automaton.add_word(c, c)
        for p in self.id:
            if len(p) > 1 and self.merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.ids_of = {t: tuple(self._ids(t)) for t in {*self.id, *self.letters}}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: Runs of late, and those before them: what is met again moves up, the rest goes when the first table is full.
        self.runs: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.shown = [str(i) for i in range(len(model.pieces))]
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def _ids(self, token: str) -> list[int]:
        if token in self.id:
            return [self.id[token]]
        return [self.bytes[b] for b in token.encode()] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the best-scored pair, the leftmost of equals."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (score := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the joined text of two pieces leaves them as they are."""
        known = self.pairs.get(a)
        if known is None:
            known = self.pairs[a] = {}
        fit = known.get(b)
        if fit is None:
            if self.n_pairs >= PAIRS:
                self.pairs.clear()
                self.n_pairs, known = 0, self.pairs.setdefault(a, {})
            fit = known[b] = self.merged(a + b) == [a, b]
            self.n_pairs += 1
        return fit

    def backtrack(self, run: str) -> list[str]:
        """The pieces of a text of known letters."""
        n = len(run)
        matches: list[list[str]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(run):
            matches[end - len(token) + 1].append(token)  # by end, so by length for each start
        failed, tokens, tries, at = 0, [], [], 0
        choice = len(matches[0]) - 1
        while True:
            found = None
            options = matches[at]
            while choice >= 0:
                token = options[choice]
                if not failed >> (at + len(token)) & 1 and (not tokens or self.fits(tokens[-1], token)):
                    found = token
                    break
                choice -= 1
            if found is not None:
                tokens.append(found)
                tries.append(choice)
                at += len(found)
                if at == n:
                    return tokens
                choice = len(matches[at]) - 1
            else:
                failed |= 1 << at
                if not tokens:
                    return self.merged(run)  # no chain of pairs: can't happen with distinct scores
                at -= len(tokens.pop())
                choice = tries.pop() - 1

    def run_ids(self, run: str) -> tuple[int, ...]:
        """The ids of a run that no piece crosses."""
        whole = self.ids_of.get(run)
        if whole is not None and self.automaton.exists(run):
            return whole
        out: list[int] = []
        for known in self._by_letters(run):
            if known[0] not in self.letters:
                out += (i for c in known for i in self._ids(c))
            else:
                tokens = self.merged(known) if any(t in known for t in self.tied) else self.backtrack(known)
                for t in tokens:
                    out += self.ids_of[t]
        return tuple(out)

    def _by_letters(self, run: str) -> list[str]:
        if self.letters.issuperset(run):
            return [run]
        out: list[str] = []
        for c in run:
            if out and (c in self.letters) == (out[-1][-1] in self.letters):
                out[-1] += c
            else:
                out.append(c)
        return out

    def _learn(self, run: str, key: str | None = None) -> tuple[int, ...]:
        """The run's ids, remembered under the key: one mark and a word under the word."""
        key = key or run
        if len(self.runs) >= RUNS:
            self.old, self.runs = self.runs, {}
        found = self.old.get(key)
        if found is None:
            found = self.run_ids(run)
        if len(run) <= 64:
            self.runs[key] = found
        return found

    def parts(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of each run of the text."""
        if not text:
            return []
        text = self.prefix + text.replace(" ", MARK)
        get, learn = self.runs.get, self._learn
        if not self.cut_at_marks:
            return [get(text) or learn(text)]
        if MARK + MARK in text or text[0] != MARK or text[-1] == MARK:
            keyed = [(r, r if r[0] == MARK else f"\0{r}") for r in _RUN.findall(text)]
            return [get(k) or learn(r, k) for r, k in keyed]
        runs = text.split(MARK)
        del runs[0]
        return [get(r) or learn(MARK + r, r) for r in runs]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))


def _encode(batches: Iterator[pa.RecordBatch], file: FileBytes, at: int, digests: bool) -> Iterator[pa.RecordBatch]:
    coder = worker_model("pieces", file, PieceEncoder)
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            ids, shown, decoded = [], [], []
            for text in batch.column(at).to_pylist():
                ids.append(coder.encode(text))
                decoded.append(coder.decoder.decode(ids[-1]))
                if digests:
                    shown.append(hashlib.sha256(",".join(map(coder.shown.__getitem__, ids[-1])).encode()).hexdigest())
            n = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                new = [n, pa.array(shown), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            else:
                new = [n, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [str(i) for i in range(len(batch.columns) + 3)])


def encode(docs: DataFrame, model: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with n_tokens, ids, decoded; or with digests, n_tokens, ids_sha256, decoded_sha256 made from those.

    A null text counts as empty: no ids, an empty decoded text. Texts of any length are encoded whole; characters that
    no piece has become byte pieces. Rows that repeat a doc_id, or lack one, are rows like any other; an empty table
    gives an empty result. Columns of docs that have one of the new names, in any case, are replaced.
    """
    ship(docs.sparkSession)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    at, file = docs.columns.index(text), FileBytes(docs.sparkSession, model)
    schema = T.StructType(list(docs.schema)).add(new[0], "long").add(new[1], T.StringType() if digests else T.ArrayType(T.IntegerType())).add(new[2], "string")
    return docs.mapInArrow(lambda b: _encode(b, file, at, digests), schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, model or public_tokenizers.path("piece_bpe_32k.model"), digests=True).drop("text")
