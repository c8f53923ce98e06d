"""SentencePiece encoding and decoding (operator 6): streaming Viterbi.

The lattice over a text has an edge for every piece.  Only a window of one
maximum piece length is kept; whenever all surviving backpointer paths meet
in one boundary, the ids before it are committed, so memory does not grow
with the text.

* unigram models: the best path has the largest sum of piece scores;
* BPE models (merge by priority): a piece may follow another only if merging
  the two strings gives exactly these two pieces.  For each prefix just one
  last piece is then possible, so the surviving path is the library's own
  segmentation.  Pieces of spaces alone share the last priority in such
  models, so runs of spaces are merged directly, after the word behind them
  has taken its mark.

Where no piece holds a word mark after another character, a word mark is
always a boundary of all paths, and likewise between letters and others;
the segments between are kept with their ids in a task's memo (bounded by its
size and emptied when the task ends; what was not met again goes first).  Those
that a group of texts lacks are encoded in order, so that a beginning in common
with the one before is not run again.

Defined cases: a null text has null ids and no round trip (null); an empty
text has no ids.  Characters that the model lacks become byte pieces, or the
unknown id if the model has none.  Rows are handled one by one, so repeated
rows and null ids are kept; columns other than id and text are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import held, texts, tidy

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Entries of a codec's tables, by their size: about 170 bytes for a segment, 430 for a step and 40 for a pair.
MEMO, STEPS, PAIRS = 350_000, 150_000, 300_000
MEMO_CHARS = 48
#: Characters of texts whose segments are looked up together.
GROUP_CHARS = 1_000_000


class Memo(dict):
    """What ``make`` gives for a segment.  Half of the entries are those met
    since the last change of halves; the others go at the next one."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, seg: str) -> bytes:
        got = self.old.pop(seg, None)
        if got is None:
            got = self.make(seg)
        if len(seg) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                super().clear()
            self[seg] = got
        return got

    def fill(self, segs: set[str]) -> None:
        """Makes what is missing of ``segs``, in order, so that neighbours
        have their beginnings in common."""
        for seg in sorted(x for x in segs.difference(self) if len(x) <= MEMO_CHARS):
            self[seg]

    def clear(self) -> None:
        super().clear()
        self.old = {}


class State(dict):
    """The longest ending of a text that begins a piece (``text``): for the
    character that comes next, the state then and the pieces that end there."""

    __slots__ = ("pieces", "text")

    def __init__(self, pieces: Pieces, text: str):
        self.pieces, self.text = pieces, text

    def __missing__(self, ch: str) -> tuple[State, tuple]:
        got = self.pieces.step(self.text + ch)
        self[ch] = got
        return got


class After(dict):
    """Whether a piece, by its number, may follow ``piece``."""

    __slots__ = ("pieces", "piece")

    def __init__(self, pieces: Pieces, piece: str):
        self.pieces, self.piece = pieces, piece

    def __missing__(self, k: int) -> bool:
        p = self.pieces
        p.room_for_pair()
        # nothing merges with an unknown character
        got = self[k] = k < 0 or p.may_follow(self.piece, p.texts[k])
        return got


class Coded(dict):
    """The ids of a piece as 32-bit integers in bytes; those of unknown characters are not kept."""

    __slots__ = ("pieces",)

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.update((p, array("i", [i]).tobytes()) for p, i in pieces.ids.items())

    def __missing__(self, piece: str) -> bytes:
        return array("i", self.pieces.piece_ids(piece)).tobytes()


class Pieces:
    """Vocabulary of a model: text pieces with scores, byte pieces, kind."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], kind: int, byte_ids: list[int] | None = None,
                 unknown: int = 0, dummy_prefix: bool = True):
        self.scores, self.ids, self.kind, self.byte_ids = scores, ids, kind, byte_ids
        self.unknown, self.dummy_prefix = unknown, dummy_prefix
        self.longest = max(map(len, scores), default=1)
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in scores)
        self.letters_apart = self.words_apart and not any(
            regex.search(r"\p{L}\P{L}|\P{L}\p{L}", p.lstrip(MARK)) for p in scores)
        order = sorted((p for p in scores if len(p) > 1), key=lambda p: -scores[p])
        self.rank = {p: i for i, p in enumerate(order)}
        self.last_spaces = all(set(p) == {MARK} for p in order[len(order) - sum(set(p) == {MARK} for p in order):])
        self._splits: dict[str, tuple[str, str] | None] = {}
        #: A number for each piece that a path may hold, and every beginning of one.
        self.numbers = {p: k for k, p in enumerate(x for x in scores if len(x) == 1 or kind != BPE or self.split_of(x))}
        self.starts = {p[:i] for p in self.numbers for i in range(1, len(p) + 1)}
        self.texts = list(self.numbers)
        self.begin, self._states, self._steps, self._pairs = State(self, ""), {}, 0, 0
        #: By the number of the piece before; the last entry is for none or an unknown character (-1).
        self.after = [*(After(self, p) for p in self.texts), b"\1" * (len(self.texts) + 1)]
        self.dead = (float("-inf"), "", None, -1, bytes(len(self.texts) + 1))
        self.worst = min(scores.values(), default=0.0) - 10.0
        self.coded = Coded(self)
        back = {i: p for p, i in ids.items()}
        bytes_of = {i: b for b, i in enumerate(byte_ids or [])}
        self.of_id = [back[i].replace(MARK, " ").encode() if i in back else bytes([bytes_of[i]]) if i in bytes_of
                      else " ⁇ ".encode() if i == unknown else b""
                      for i in range(1 + max([unknown, *back, *bytes_of]))]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models with identity normalisation")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(n))) else None
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in plain}, {sp.id_to_piece(i): i for i in plain}, kind,
                   byte_ids, sp.unk_id(), norm.add_dummy_prefix)

    def merged(self, s: str) -> list[str]:
        """Segmentation by merging: the neighbouring pair whose joined piece
        has the highest score first, the leftmost among equals.  For pairs of
        pieces and runs of spaces, so always short."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split_of(self, s: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives ``s``; None if merging the
        characters of ``s`` never reaches it."""
        if s not in self._splits:
            parts = list(s)
            while len(parts) > 2:
                at = min((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank),
                         key=lambda i: self.rank[parts[i] + parts[i + 1]], default=None)
                if at is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._splits[s] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._splits[s]

    def step(self, s: str) -> tuple[State, tuple]:
        """For ``s``, which is the longest ending of the text before that
        begins a piece, and one more character: the longest ending that
        begins a piece now, and the pieces that end here from long to short
        as (number, minus length, piece, what may follow).  An unknown
        character is a piece too."""
        if self._steps >= STEPS:
            self._steps = 0
            for x in (self.begin, *self._states.values()):
                x.clear()
            self._states.clear()
        self._steps += 1
        text = next((s[i:] for i in range(len(s)) if s[i:] in self.starts), "")
        ends = tuple((k, i - len(text), self.texts[k], self.after[k]) for i in range(len(text))
                     if (k := self.numbers.get(text[i:])) is not None)
        if not ends or ends[-1][1] < -1:
            ends += ((-1, -1, s[-1], self.after[-1]),)
        if text and text not in self._states:
            self._states[text] = State(self, text)
        return self._states[text] if text else self.begin, ends

    def room_for_pair(self) -> None:
        if self._pairs >= PAIRS:
            self._pairs = 0
            for x in self.after[:-1]:
                x.clear()
        self._pairs += 1

    def may_follow(self, a: str, b: str) -> bool:
        """BPE: merging a + b gives just (a, b).  Undoes the merges inside
        both, the last one first; a merge across the border must never have
        come before the one undone (the leftmost first among equals)."""
        rank, before = self.rank, len(self.rank) + 1
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                before, a = ra, self.split_of(a)[1]
            elif rb >= 0:
                before, b = rb + 1, self.split_of(b)[0]
            else:
                return True

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]


class StreamingViterbi:
    """Feeds characters, commits pieces; holds at most the open window and
    the paths that have not met yet."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.reset()

    def reset(self) -> None:
        self.state, self.open, self.at = self.p.begin, 0, 0
        #: Node of a boundary: (score, piece, node before, position, what may follow the piece).
        self.live: list = [(0.0, "", None, 0, self.p.after[-1])]
        self.committed: list[str] = []
        #: For ``path``: the text before, with the state and the node of each of its boundaries.
        self.last, self.states, self.nodes = "", [self.state], self.live[:]

    def _run(self, chars: str, at: int, states: list, live: list) -> None:
        """Adds to ``states`` and ``live`` for each character: the best path to its end is a node."""
        state = states[-1]
        scores, worst, dead, bpe = self.p.scores, self.p.worst, self.p.dead, self.p.kind == BPE
        for ch in chars:
            state, ends = state[ch]
            node, at = dead, at + 1
            if bpe:
                for k, n, piece, after in ends:
                    before = live[n]
                    if before[4][k]:
                        node = (0.0, piece, before, at, after)
                        break
            else:
                for k, n, piece, after in ends:
                    before = live[n]
                    total = before[0] + scores.get(piece, worst)
                    if total > node[0]:
                        node = (total, piece, before, at, after)
            live.append(node)
            states.append(state)

    def feed(self, chars: str) -> None:
        longest = self.p.longest
        for i in range(0, len(chars), 4 * longest):
            block = chars[i:i + 4 * longest]
            states = [self.state]
            self._run(block, self.at, states, self.live)
            self.state = states[-1]
            self.at += len(block)
            if len(self.live) > longest:
                del self.live[:-longest]
            self.open += len(block)
            if self.open >= 4 * longest:
                self.open = 0
                self._commit()

    def path(self, text: str) -> list[str]:
        """The pieces of a short text; the nodes of the beginning that it has
        in common with the short text before are kept."""
        states, nodes, n = self.states, self.nodes, 0
        for a, b in zip(self.last, text):
            if a != b:
                break
            n += 1
        del states[n + 1:], nodes[n + 1:]
        self._run(text[n:], n, states, nodes)
        self.last = text
        return self._back(nodes[-1])

    @staticmethod
    def _back(node: tuple) -> list[str]:
        path = []
        while node[2] is not None:
            path.append(node[1])
            node = node[2]
        return path[::-1]

    def _commit(self) -> None:
        """Ids before the boundary in which all live paths meet are final."""
        heads = {id(x): x for x in self.live if x is not self.p.dead}
        while len(heads) > 1:
            last = max(heads.values(), key=lambda x: x[3])
            del heads[id(last)]
            if last[2] is not None:
                heads[id(last[2])] = last[2]
            else:
                return
        root = next(iter(heads.values()))
        path = self._back(root)
        if path:
            self.committed += path
            base = (root[0], root[1], None, root[3], root[4])
            seen = {id(root): base}

            def cut(x):
                if id(x) not in seen:
                    seen[id(x)] = (x[0], x[1], cut(x[2]), x[3], x[4])
                return seen[id(x)]
            self.live = [x if x is self.p.dead else cut(x) for x in self.live]

    def finish(self) -> list[str]:
        out = self.committed + self._back(self.live[-1])
        self.reset()
        return out


class Codec:
    """Encoding and decoding of texts in one task."""

    def __init__(self, pieces: Pieces):
        self.p, self.viterbi, self.memo = pieces, StreamingViterbi(pieces), Memo(self._segment)
        if pieces.words_apart and (pieces.kind == UNIGRAM or pieces.last_spaces):
            #: A word with all spaces before it, or the spaces at the end; if
            #: no piece joins letters and others, these are apart as well.
            self.cut = regex.compile(r" *\p{L}+| *[^ \p{L}]+| +" if pieces.letters_apart else " *[^ ]+| +")
        elif pieces.kind == UNIGRAM:
            self.cut = regex.compile(r"(?s).+")
        else:
            raise ValueError("this BPE model joins words, or merges spaces before letters")

    def _paths(self, s: str) -> list[str]:
        if len(s) <= MEMO_CHARS:
            return self.viterbi.path(s)
        self.viterbi.feed(s)
        return self.viterbi.finish()

    def _segment(self, s: str) -> bytes:
        s = s.replace(" ", MARK)
        if self.p.kind == UNIGRAM or not s.startswith(MARK + MARK):
            found = self._paths(s)
        else:
            word = s.lstrip(MARK)
            n = len(s) - len(word)
            if not word:
                found = self._spaces(n)
            else:
                found = self._paths(MARK + word)
                found = self._spaces(n) + found[1:] if found[0] == MARK else self._spaces(n - 1) + found
        coded = self.p.coded
        return b"".join([coded[x] for x in found])

    def _spaces(self, n: int) -> list[str]:
        """A run of spaces, merged from the left: all their merges have one
        priority, so whole blocks of the longest piece fill up first."""
        block, out = 4 * self.p.longest, []
        while n > 2 * block:
            out += self.p.merged(MARK * block)
            n -= block
        return out + self.p.merged(MARK * n)

    def encode(self, text: str) -> list[int]:
        return next(self.encoded([text]))[1].tolist()

    def encoded(self, texts: Iterable[str | None]) -> Iterator[tuple[str | None, np.ndarray]]:
        """Each text with its ids (null: none)."""
        group, chars = [], 0
        for text in texts:
            group.append((text, self._segments(text or "")))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._looked_up(group)
                group, chars = [], 0
        yield from self._looked_up(group)

    def _segments(self, text: str) -> list[str]:
        s = text.replace(MARK, " ")     # a mark in a text is a space too
        return self.cut.findall(" " + s if s and self.p.dummy_prefix else s)

    def _looked_up(self, group: list[tuple[str | None, list[str]]]) -> Iterator[tuple[str | None, np.ndarray]]:
        self.memo.fill(set().union(*(segs for _, segs in group)))
        for text, segs in group:
            yield text, np.frombuffer(b"".join(map(self.memo.__getitem__, segs)), np.int32)

    def forget(self) -> None:
        """The segments go; steps and pairs, which all texts share, stay for
        the worker's next task."""
        self.memo.clear()

    def decode(self, ids) -> str:
        of = self.p.of_id
        s = b"".join(map(of.__getitem__, ids)).decode("utf-8", errors="replace")
        return s[1:] if self.p.dummy_prefix and s.startswith(" ") else s


def codec(model: str) -> Codec:
    """The worker's codec of this model."""
    return held(("pieces", model), lambda: Codec(Pieces.load(model)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (array of int), round_trip
    (decoding the ids gives the text again)."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        try:
            for whole in batches:
                for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                    n, flat, ends, same = [], [], [0], []
                    for text, ids in c.encoded(texts(batch.column(1))):
                        n.append(None if text is None else len(ids))
                        same.append(None if text is None else c.decode(ids.tolist()) == text)
                        flat.append(ids)
                        ends.append(ends[-1] + len(ids))
                    values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values,
                                                     mask=pa.array([x is None for x in n], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], names=schema.names)
        finally:
            c.forget()

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The input with the decoded text in ``out_col``; null ids give null."""
    keep = [c for c in rows.columns if c != out_col]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            got = [None if x is None else c.decode(x) for x in texts(batch.column(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)
