"""SentencePiece encoding and decoding by a max-plus scan.

The pieces of a SentencePiece model file are read as a lexicon for sums: a text's encoding is
the segmentation with the largest sum of scores (ties: the longest last piece). The scores of
a unigram file are log probabilities and are summed as they are. Those of a byte-pair file are
merge ranks, which do not suit a sum (two early merges would beat the one piece that they make
up), so a piece costs ``PIECE_COST`` and its rank: the fewest pieces win, and among these the
earliest merged ones.

That best path is a product of max-plus matrices, which is associative. A text of more than
``CHUNK`` bytes is split into chunks of fixed length, wherever the cut falls; each chunk
yields the matrix that takes the scores of the states at its left boundary to those at its
right one, the matrices are combined in a tree, and each chunk is then backtraced on its own
between the boundary states found. A state at a boundary is the distance back to the last
piece end before it. Shorter texts are one chunk. Inside a chunk every path passes the places
before a space mark or a line end, so its matrix is that of the characters up to the first such place, plus
the sum of the words up to the last one, plus that of the characters behind.

Scores are integers, so sums are exact and ties do not depend on the split.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import KEPT, Scratch, cut, fresh, replace_columns, ship, small_batches, table, trim_memory

SPACE = "▁"
CHUNK = 1 << 15  # characters of a long text in a chunk; texts of fewer bytes are one chunk
FAN = 64  # chunks that are combined at a time
CHUNKS_AT_ONCE = 32  # chunks in a batch that goes to Python
TEXTS_AT_ONCE = 500  # texts in a batch that goes to Python
CHARACTERS_AT_ONCE = 1 << 20  # of texts that are cut into words together
CACHE_BYTES = 32 << 20  # about, of words whose ids are kept; as many older ones are kept besides
LONGEST_CACHED = 48
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # kinds of pieces in the model file
BYTE_PAIRS = 2  # kind of model, in the trainer's settings
PIECE_COST = 1 << 24  # more than the ranks of a word's pieces add up to
SCALE = 1 << 16  # of log probabilities
LOW = -(1 << 60)
WORDS_AT_ONCE = 1 << 12  # short ones, whose best paths are found together
# Hash table of the strings that begin pieces: the multipliers of the two places of a key; a key holds
# the string without its last character (its number) and that character.
_SLOTS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_CHARACTER_BITS, _NO_CHARACTER = 21, 0x110000
_UNKNOWN = 1 << 31  # and a character: stands for its bytes in a path


def _fields(data: bytes):
    """(field, value) of a protocol-buffer message: integers, or bytes for the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, data[at:at + size]
        at += size


class Lexicon:
    """Pieces of a model file: ids and scores by string, and the bytes each id decodes to."""

    def __init__(self, model: bytes):
        raw, pairs = [], False
        for field, value in _fields(model):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    piece = v.decode() if f == 1 else piece
                    score = struct.unpack("<f", v)[0] if f == 2 else score
                    kind = v if f == 3 else kind
                raw.append((piece, score, kind))
            elif field == 2:
                pairs = dict(_fields(value)).get(3) == BYTE_PAIRS
        # A rank beyond the file's length marks a piece that no merge makes: it counts as the last.
        held = [(p, max(round(s), -len(raw)) - PIECE_COST if pairs else round(s * SCALE), k) for p, s, k in raw]
        normal = [s for _, s, k in held if k == NORMAL]
        top = 0 if pairs else max(normal, default=0)
        self.unknown = min(normal, default=0) - (PIECE_COST if pairs else 10 * SCALE)
        self.score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.text: list[bytes] = []
        for i, (piece, score, kind) in enumerate(held):
            self.text.append(b"")
            if kind in (NORMAL, USER_DEFINED):
                self.id[piece] = i
                # user-defined symbols always win over the pieces they hold
                self.score[piece] = score if kind == NORMAL else len(piece.encode()) * top
                self.text[i] = piece.replace(SPACE, " ").encode()
            elif kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
        self.longest = max(map(len, self.score), default=1)
        # Every path passes a place before a space mark that follows another character.
        self.cuts = not any(b == SPACE != a for p in self.score for a, b in zip(p, p[1:], strict=False))
        self.line_cuts = not any("\n" in p for p in self.score if len(p) > 1)
        line = "\n" if self.line_cuts else ""
        self._word_starts = re.compile(f"(?<!{SPACE}){SPACE}" + ("|\n" if line else ""))
        self._marked_words = re.compile(f"{SPACE}+[^{SPACE}{line}]*" + (f"|\n[^{SPACE}\n]*" if line else ""))
        # Ids of words (see ``keys``), in two generations: a full one replaces the older one, words in use move over.
        self.cache_bytes = CACHE_BYTES
        self.forget()
        self._build_table()

    @functools.cached_property
    def begins(self) -> dict[str, int | None]:
        """Scores of pieces, and None for strings that only begin pieces."""
        return {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score

    # -- many short spans at a time --------------------------------------------------------
    def _build_table(self) -> None:
        """Hash table of the strings that begin pieces, for lookups by whole arrays; string 0 is the empty one."""
        number, keys = {"": 0}, [1 << 63]  # a key that is never looked for
        for p in self.score:
            for n in range(1, len(p) + 1):
                if p[:n] not in number:
                    number[p[:n]] = len(keys)
                    keys.append(number[p[:n - 1]] << _CHARACTER_BITS | ord(p[n - 1]))
        bits = max(10, (4 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        places = [[0] * (1 << bits) for _ in _SLOTS]
        for i in range(1, len(keys)):
            for turn in range(500):  # a string takes its place, the one that was there goes to its other place
                held = places[turn % 2]
                at = (keys[i] * _SLOTS[turn % 2] & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                held[at], i = i, held[at]
                if not i:
                    break
            else:
                raise ValueError("the piece table is too small for this model")
        self._keys = np.array(keys, np.uint64)
        self._places = [np.array(held, np.int32) for held in places]
        self._piece_of = np.full(len(keys), -1, np.int32)
        self._score_of = np.full(len(self.text), LOW, np.int64)
        for p, i in self.id.items():
            self._piece_of[number[p]] = i
            self._score_of[i] = self.score[p]
        # The sum of a path by its ids: an unknown character counts once, at its first byte.
        self._sum_of = np.where(self._score_of == LOW, 0, self._score_of)
        for c in range(256):
            if c & 0xC0 != 0x80 and self.text[self.byte_id[c]] == bytes([c]):
                self._sum_of[self.byte_id[c]] = self.unknown

    def _longer(self, begin: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Numbers of the strings with one more character, 0 where no piece begins so."""
        key = begin.astype(np.uint64) << np.uint64(_CHARACTER_BITS) | code
        a, b = (held[(key * np.uint64(m) >> self._shift).astype(np.int64)]
                for held, m in zip(self._places, _SLOTS, strict=True))
        return np.where(self._keys[a] == key, a, np.where(self._keys[b] == key, b, 0))

    def words(self, keys: list[str]) -> list[bytes]:
        """Ids of words, many short ones together."""
        marked = [self.marked_word(k) for k in keys]
        short = [w for w in marked if len(w) <= LONGEST_CACHED]
        found = itertools.chain.from_iterable(
            self._together(short[at:at + WORDS_AT_ONCE]) for at in range(0, len(short), WORDS_AT_ONCE))
        return [next(found) if len(w) <= LONGEST_CACHED else self.word(w) for w in marked]

    def _together(self, words: list[str]) -> list[bytes]:
        """``word`` of short spans, none of them empty."""
        sizes = np.array(list(map(len, words)))
        code = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        stops = np.cumsum(sizes + 1) - 1
        begins = stops - sizes
        code[stops] = _NO_CHARACTER  # no piece goes on behind a word
        # Pieces by their first place, those of one size together.
        held, at, begin = [], np.arange(len(code)), np.zeros(len(code), np.int32)
        for size in range(1, self.longest + 1):
            begin = self._longer(begin, code[at + (size - 1)])
            going = np.flatnonzero(begin)
            at, begin = at[going], begin[going]
            ids = self._piece_of[begin]
            whole = np.flatnonzero(ids >= 0)
            held.append((at[whole], at[whole] + size, ids[whole]))
            if not len(at):
                break
        unknown = np.ones(len(code), bool)
        unknown[held[0][0]] = unknown[stops] = False
        at = np.flatnonzero(unknown)
        held.append((at, at + 1, _UNKNOWN + code[at].astype(np.int64)))
        # In the order of their place in the word: the first of equal sums has the longest last piece.
        start, end, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        place = (np.arange(len(code)) - np.repeat(begins, sizes + 1)).astype(np.uint8)[start]
        order = np.argsort(place, kind="stable")
        start, end, ids = start[order], end[order], ids[order]
        scores = np.where(ids < _UNKNOWN, self._score_of[np.where(ids < _UNKNOWN, ids, 0)], self.unknown)
        best, last = np.full(len(code), LOW, np.int64), np.zeros(len(code), np.int64)
        best[begins] = 0
        low = 0
        for high in np.cumsum(np.bincount(place)).tolist():
            to, options = end[low:high], best[start[low:high]] + scores[low:high]
            better = np.flatnonzero(options > best[to])  # a word's pieces from one place end at different ones
            best[to[better]] = options[better]
            last[to[better]] = better + low
            low = high
        # Back from the words' ends, a piece of every word that is not done at a time.
        row = np.arange(len(words))
        here, rounds, count = stops, [], np.zeros(len(words), np.int64)
        while len(row):
            piece = last[here]
            rounds.append((row, ids[piece]))
            count[row] += 1
            here = start[piece]
            going = np.flatnonzero(here > begins[row])
            row, here = row[going], here[going]
        ends = np.cumsum(count)
        path = np.zeros(int(count.sum()), np.int64)
        for n, (row, piece) in enumerate(rounds, 1):
            path[ends[row] - n] = piece
        data, at = path.astype("<u4").tobytes(), (4 * ends).tolist()
        out = [data[a:b] for a, b in zip([0, *at], at, strict=False)]
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(path >= _UNKNOWN), "right")).tolist():
            out[i] = np.array([x for v in path[ends[i] - count[i]:ends[i]].tolist() for x in (
                [v] if v < _UNKNOWN else self._bytes_of(chr(v - _UNKNOWN)))], "<u4").tobytes()
        return out

    def _bytes_of(self, character: str) -> list[int]:
        return [self.byte_id[c] for c in character.encode("utf-8", "surrogatepass")]

    # -- one span ------------------------------------------------------------------------
    def forward(self, text: str, entry: list[int], lead: int) -> tuple[list[int], list[int]]:
        """Best sums and last piece starts for the places of ``text``; ``lead`` characters lie before it.

        ``entry[k]`` is the sum at the place k characters before the first place; pieces that
        start there must end behind it.
        """
        best = [LOW] * (len(text) + 1)
        start = [-1] * (len(text) + 1)
        for k, v in enumerate(entry[:lead + 1]):
            best[lead - k] = v
        look, size = self.begins.get, len(text)
        for at in range(size):
            here = best[at]
            if here == LOW:
                continue
            for end in range(at + 1 if at >= lead else lead + 1, size + 1):
                s = look(text[at:end], False)
                if s is False:
                    break
                if s is not None and here + s > best[end]:
                    best[end] = here + s
                    start[end] = at
            if at >= lead and text[at] not in self.score and here + self.unknown > best[at + 1]:
                best[at + 1] = here + self.unknown
                start[at + 1] = at
        return best, start

    def ids_between(self, text: str, start: list[int], end: int, lead: int) -> tuple[list[int], int]:
        """Ids of the best path from where it enters (``<= lead``) to ``end``, and that place."""
        spans = []
        while end > lead:
            spans.append((start[end], end))
            end = start[end]
        out: list[int] = []
        for a, b in reversed(spans):
            i = self.id.get(text[a:b])
            out.extend([i] if i is not None else self._bytes_of(text[a:b]))
        return out, end

    def word(self, word: str) -> bytes:
        """Ids (32 bits each) of a span between places that every path passes."""
        best, start = self.forward(word, [0], 0)
        return np.array(self.ids_between(word, start, len(word), 0)[0], "<u4").tobytes()

    def forget(self) -> None:
        """Drop the words that are kept."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.passing: list[str] = []
        self.known_bytes = 0

    def learn(self, words: set[str]) -> None:
        """``known`` holds the ids of all these words, until the next call at least."""
        for w in self.passing:
            del self.known[w]
        self.passing = []
        new = words.difference(self.known)
        if new and self.known_bytes > self.cache_bytes:
            self.known, self.older, self.known_bytes = {}, self.known, 0
            new = words
        unseen = list(new.difference(self.older))
        fresh = dict(zip(unseen, self.words(unseen), strict=True))
        if len(fresh) < len(new):
            fresh.update((w, self.older[w]) for w in new if w in self.older)
        self.known.update(fresh)
        self.passing = [w for w in fresh if len(w) > LONGEST_CACHED]
        # with the objects' own size
        self.known_bytes += sum(map(len, fresh)) + sum(map(len, fresh.values())) + 180 * len(fresh)
        self.known_bytes -= sum([len(w) + len(fresh[w]) + 180 for w in self.passing])

    def ids_of(self, words: list[str]) -> bytes:
        """Ids (32 bits each) of the words, one behind the other."""
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return b"".join(map(self.known.__getitem__, words))

    def marked(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text that is one chunk."""
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list[np.ndarray]:
        """Ids of texts that are one chunk each, cut into words so many characters at a time."""
        texts, out, begin = list(texts), [], 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end] or "") <= CHARACTERS_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            keys = [self.keys(self.marked(t)) if t else [] for t in texts[begin:end]]
            self.learn(set(itertools.chain.from_iterable(keys)))
            out += [np.frombuffer(self.ids_of(x), "<u4").astype(np.int32) for x in keys]
            begin = end
        return out

    def keys(self, marked: str) -> list[str]:
        """Words of a marked text, cut at places that every path passes: before space marks and line ends.

        The text begins with one of these. A word's first space mark is left out, see ``marked_word``.
        """
        if not self.cuts:
            return [marked[1:]]
        apart = marked.replace("\n", SPACE + "\n") if self.line_cuts else marked
        if SPACE + SPACE not in apart:
            return apart.split(SPACE)[1:]
        return [w[1:] if w[0] == SPACE else w for w in self._marked_words.findall(marked)]

    def marked_word(self, key: str) -> str:
        return key if self.line_cuts and key[:1] == "\n" else SPACE + key

    def decode(self, ids) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # -- chunks --------------------------------------------------------------------------
    def first_cut(self, text: str, lead: int) -> int | None:
        """The first place of a chunk, ``text`` behind its ``lead`` characters, that every path passes."""
        # A place tells by the character before it; the first has none, unless the text begins there.
        found = self._word_starts.search(text, max(lead, 1) if lead else 0) if self.cuts else None
        return found and found.start()

    def inside(self, text: str, lead: int) -> tuple[int, list[str], int] | None:
        """(first, words, last): the first and last place of a chunk that every path passes, and the words between.

        The chunk is ``text`` behind its ``lead`` characters; None if it has no such place.
        """
        first = self.first_cut(text, lead)
        if first is None:
            return None
        last = text.rfind(SPACE)
        while last > first and text[last - 1] == SPACE:
            last -= 1
        last = max(first, last, text.rfind("\n") if self.line_cuts else -1)
        return first, self.keys(text[first:last]) if last > first else [], last

    def insides(self, texts, leads) -> list[tuple[int, list[str], int] | None]:
        """``inside`` of many chunks, whose words are learnt together: arrays are then long."""
        places = [self.inside(t, n) for t, n in zip(texts, leads, strict=True)]
        self.learn(set(itertools.chain.from_iterable(p[1] for p in places if p)))
        return places

    def matrix(self, text: str, lead: int, places: tuple[int, list[str], int] | None) -> np.ndarray:
        """[entry state, exit state] sums over the chunk behind the ``lead`` characters; ``places``: ``inside``."""
        size = self.longest
        out = np.full((size, size), -np.inf)
        if places is None:
            for k in range(lead + 1):
                entry = [LOW] * (lead + 1)
                entry[k] = 0
                best, _ = self.forward(text, entry, lead)
                for j in range(size):
                    if len(text) - j > lead and best[len(text) - j] > LOW:
                        out[k, j] = best[len(text) - j]
            return out
        first, words, last = places
        head = self.backward(text[:first], lead)
        between = int(self._sum_of[np.frombuffer(self.ids_of(words), "<u4")].sum())
        tail, _ = self.forward(text[last:], [0], 0)
        left = np.array([-np.inf if v == LOW else v for v in head], float)
        right = np.array([-np.inf if v == LOW else v for v in tail[::-1][:size]], float)
        right[max(0, len(text) - lead):] = -np.inf  # a piece must end behind the boundary
        out[:len(left), :len(right)] = left[:, None] + (right + between)[None]
        return out

    def backward(self, text: str, lead: int) -> list[int]:
        """Best sums from each entry state 0 … lead to the end of ``text``."""
        size, look = len(text), self.begins.get
        best = [LOW] * size + [0]
        for at in range(size - 1, -1, -1):
            top = LOW
            for end in range(at + 1, size + 1):
                s = look(text[at:end], False)
                if s is False:
                    break
                if s is not None and end > lead and best[end] > LOW and s + best[end] > top:
                    top = s + best[end]
            if at >= lead and text[at] not in self.score and best[at + 1] > LOW and self.unknown + best[at + 1] > top:
                top = self.unknown + best[at + 1]
            best[at] = top
        return [best[lead - k] for k in range(lead + 1)]

    def entries(self, text: str, entry: list[int], lead: int) -> bytes:
        """For every exit state, the entry state that its best path comes from."""
        back = bytearray(self.longest)
        first = self.first_cut(text, lead)
        upto = text if first is None else text[:first]
        best, start = self.forward(upto, entry, lead)
        for j in range(self.longest):
            end = len(text) - j if first is None else first
            if len(text) - j > lead and best[end] > LOW:
                while end > lead:
                    end = start[end]
                back[j] = lead - end
        return bytes(back)

    def trace(self, text: str, entry: list[int], lead: int, exit_state: int,
              places: tuple[int, list[str], int] | None) -> np.ndarray:
        """Ids of the best path of a chunk that leaves it in ``exit_state``; ``places``: ``inside``."""
        if places is None:
            _, start = self.forward(text, entry, lead)
            return np.array(self.ids_between(text, start, len(text) - exit_state, lead)[0], np.int32)
        first, words, last = places
        _, start = self.forward(text[:first], entry, lead)
        head = np.array(self.ids_between(text[:first], start, first, lead)[0], "<u4").tobytes()
        _, start = self.forward(text[last:], [0], 0)
        tail = np.array(self.ids_between(text[last:], start, len(text) - last - exit_state, 0)[0], "<u4").tobytes()
        return np.frombuffer(head + self.ids_of(words) + tail, "<u4").astype(np.int32)


_LEXICONS: dict[str, Lexicon] = {}
KEPT.append(_LEXICONS)


def lexicon(path: str) -> Lexicon:
    """The worker's lexicon of a model file (public tokenizer files are installed on every machine)."""
    if path not in _LEXICONS:
        with open(path, "rb") as fh:
            _LEXICONS[path] = Lexicon(fh.read())
    return _LEXICONS[path]


def end_of_task() -> None:
    """Give memory back, but for the lexicons: without their words, they serve the worker's next tasks.

    Tasks call it by its name; a function that names ``_LEXICONS`` itself would be sent with a copy.
    """
    for lex in _LEXICONS.values():
        lex.forget()
    trim_memory(_LEXICONS)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


# -- scan over chunks ----------------------------------------------------------------------
def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def _scan(elements: DataFrame, compose, apply, first: bytes) -> DataFrame:
    """(doc, at, state): the state before each (doc, at, element), in ``at`` order.

    ``compose(a, b)`` joins two elements, a first; ``apply(state, element)`` moves a state over
    one. At most ``FAN`` elements meet in a group; levels grow with the logarithm of the chunks.
    """
    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for e in pdf.sort_values("at")["element"]:
            total = e if total is None else compose(total, e)
        return pd.DataFrame({"doc": [key[0]], "at": [key[1]], "element": [total]})

    def spread(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        state, out = pdf["state"].iloc[0], []
        for e in pdf["element"]:
            out.append(state)
            state = apply(state, e)
        return pd.DataFrame({"doc": pdf["doc"].values, "at": pdf["at"].values, "state": out})

    chunks = (elements.agg(F.max("at")).first()[0] or 0) + 1
    levels = [elements]
    while chunks > FAN:
        up = levels[-1].groupBy("doc", F.floor(F.col("at") / FAN).alias("block"))
        levels.append(cut(up.applyInPandas(fold, "doc long, at long, element binary")))
        chunks = -(-chunks // FAN)
    state = levels[-1].select("doc", F.lit(0).cast("long").alias("block")).distinct().withColumn("state", F.lit(first))
    for level in reversed(levels):
        held = level.withColumn("block", F.floor(F.col("at") / FAN)).join(state, ["doc", "block"])
        state = (held.groupBy("doc", "block").applyInPandas(spread, "doc long, at long, state binary")
                 .withColumnRenamed("at", "block"))
    return state.withColumnRenamed("block", "at")


def encode_chunks(texts: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """(doc, ids) of (doc, text) rows, distinct doc, every text split into chunks."""
    spark = texts.sparkSession
    ship(spark)
    size = lexicon(model).longest
    assert chunk >= size

    def split(frames):
        for pdf in frames:
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                marked = lexicon(model).marked(text)
                for n, at in enumerate(range(0, len(marked), chunk)):
                    lead = min(at, size - 1)
                    yield pd.DataFrame({"doc": [doc], "at": [n], "lead": [lead], "last": [at + chunk >= len(marked)],
                                        "body": [marked[at - lead:at + chunk]]})

    def matrices(frames):
        for pdf in frames:
            lex = lexicon(model)
            made = [lex.matrix(text, lead, places).tobytes() for text, lead, places in
                    zip(pdf["body"], pdf["lead"], lex.insides(pdf["body"], pdf["lead"]), strict=True)]
            yield pd.DataFrame({"doc": pdf["doc"], "at": pdf["at"], "element": made})

    def square(b: bytes) -> np.ndarray:
        return np.frombuffer(b).reshape(size, size)

    def entry_of(state: bytes) -> list[int]:
        return [LOW if v == -np.inf else int(v) for v in np.frombuffer(state)]

    def tables(frames):
        for pdf in frames:
            made = [lexicon(model).entries(text, entry_of(state), lead)
                    for text, lead, state in zip(pdf["body"], pdf["lead"], pdf["state"], strict=True)]
            yield pd.DataFrame({"doc": pdf["doc"], "at": pdf["at"], "element": made})

    def trace(frames):
        for pdf in frames:
            lex = lexicon(model)
            places = lex.insides(pdf["body"], pdf["lead"])
            made = [lex.trace(text, entry_of(state), lead, exit_[0], x) for text, lead, state, exit_, x in
                    zip(pdf["body"], pdf["lead"], pdf["state"], pdf["exit"], places, strict=True)]
            yield pd.DataFrame({"doc": pdf["doc"], "at": pdf["at"], "ids": made})

    scratch = Scratch(spark, "pieces")
    with small_batches(spark, CHUNKS_AT_ONCE):
        chunks = scratch.write(texts.mapInPandas(split, "doc long, at long, lead int, last boolean, body string"), "chunks")
        start = np.full(size, -np.inf)
        start[0] = 0
        elements = scratch.write(chunks.mapInPandas(matrices, "doc long, at long, element binary"), "elements")
        entry = _scan(elements, lambda a, b: _product(square(a), square(b)).tobytes(),
                      lambda s, m: (np.frombuffer(s)[:, None] + square(m)).max(0).tobytes(), start.tobytes())
        entered = scratch.write(chunks.join(entry, ["doc", "at"]), "entered")
        back = scratch.write(entered.mapInPandas(tables, "doc long, at long, element binary"), "back")
        # Reversed, so that every text's last chunk is block 0 and starts from exit state 0.
        last = chunks.filter("last").select("doc", F.col("at").alias("_last"))
        turned = back.join(last, "doc").select("doc", (F.col("_last") - F.col("at")).alias("at"), "element")
        left = (_scan(turned, lambda a, b: bytes(b[x] for x in a), lambda s, t: bytes([t[s[0]]]), bytes([0]))
                .join(last, "doc").select("doc", (F.col("_last") - F.col("at")).alias("at"), F.col("state").alias("exit")))
        traced = entered.join(left, ["doc", "at"]).mapInPandas(trace, "doc long, at long, ids array<int>")
        parts = traced.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("_p"))
        out = scratch.write(parts.select("doc", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids")), "ids")
    scratch.drop("chunks", "elements", "entered", "back")
    return out


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``ids`` (array<int>; a column of that name is replaced).

    Every whole text is encoded; null and empty texts have no ids. Texts of over ``chunk``
    bytes go through the scan over chunks, with equal results. Repeated rows are encoded
    apart; an empty table stays empty. A literal U+2581 counts as a space, as in the model.
    """
    model = model or default_model()
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def whole(texts: pd.Series) -> pd.Series:
        lex, out = lexicon(model), []
        for at in range(0, len(texts), 256):
            out += lex.encode_all(texts.iloc[at:at + 256])
        return pd.Series(out)

    whole = whole.asNondeterministic()  # else every later use of the ids would encode anew
    giant = F.coalesce(F.octet_length(F.col(text_col)) > chunk, F.lit(False))
    short = replace_columns(docs.filter(~giant), ids=whole(F.col(text_col)))
    doc, found_ids = fresh(docs, "_doc"), fresh(docs, "_ids")
    long = Scratch(docs.sparkSession, "long").write(docs.filter(giant).withColumn(doc, F.monotonically_increasing_id()), "long")
    if long.isEmpty():
        return short
    found = encode_chunks(long.select(F.col(doc).alias("doc"), F.col(text_col).alias("text")), model, chunk)
    joined = long.join(found.withColumnsRenamed({"doc": doc, "ids": found_ids}), doc)
    return short.unionByName(replace_columns(joined, ids=F.col(found_ids)).drop(doc, found_ids))


def decode(ids: Column, spark: SparkSession, model: str | None = None) -> Column:
    """Text of an array of ids."""
    model = model or default_model()
    ship(spark)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        lex = lexicon(model)
        return pd.Series([None if r is None else lex.decode(r.tolist()) for r in rows])

    return run(ids)


def encoded_and_decoded(docs: DataFrame, spark: SparkSession, chunk: int = CHUNK,
                        cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) of documents, from their real ids and decoded texts.

    The ids of a text that is one chunk are digested by the task that makes them; those of
    longer texts come from the scan over chunks and are digested from its table. round_trip
    tells whether the ids decode to the text, in which a literal U+2581 counts as a space.

    Null and empty texts have no tokens, crc32 0 and a true round trip. There is a row for
    each input row: repeated rows and null ids stay as they are. Columns other than doc_id and
    text are ignored; an empty table gives no rows. Texts of any length are encoded whole.
    ``cache_bytes`` bounds a worker's cache of words; it costs or saves time, the rows are the same.
    """
    model = default_model()
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(ids: np.ndarray, text: str | None) -> tuple:
        import zlib
        return (len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                lexicon(model).decode(ids.tolist()) == (text or "").replace(SPACE, " "))

    def digests(made):
        def run(frames):
            for pdf in frames:
                lexicon(model).cache_bytes = cache_bytes
                rows = [digest(ids, t) for ids, t in zip(made(pdf), pdf["text"], strict=True)]
                found = pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "round_trip"])
                found.insert(0, "doc_id", pdf["doc_id"].values)
                yield found
            end_of_task()
        return run

    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean"
    giant = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    texts = docs.select("doc_id", "text")
    scratch = Scratch(spark, "encoded")
    # A missing id would make whole numbers floats on the way through pandas: it goes around.
    short = texts.filter(~giant)
    with small_batches(spark, TEXTS_AT_ONCE):
        rows = scratch.write(short.filter("doc_id is not null").mapInPandas(
            digests(lambda pdf: lexicon(model).encode_all(pdf["text"])), schema), "rows")
        bare = scratch.write(short.filter("doc_id is null").select(F.lit(0).cast(kind).alias("doc_id"), "text").mapInPandas(
            digests(lambda pdf: lexicon(model).encode_all(pdf["text"])), schema), "bare")
    out = rows.unionByName(bare.withColumn("doc_id", F.lit(None).cast(kind)))
    long = scratch.write(texts.filter(giant).withColumn("_doc", F.monotonically_increasing_id()), "long")
    if long.isEmpty():
        return out
    found = encode_chunks(long.select(F.col("_doc").alias("doc"), "text"), model, chunk)
    with small_batches(spark, CHUNKS_AT_ONCE):
        ended = long.join(found, F.col("_doc") == F.col("doc")).select(F.col("_doc").alias("doc_id"), "text", "ids")
        known = scratch.write(ended.mapInPandas(digests(lambda pdf: pdf["ids"]), schema.replace(f"doc_id {kind}", "doc_id long")), "known")
    return out.unionByName(long.select("doc_id", "_doc").join(known.withColumnRenamed("doc_id", "_doc"), "_doc").drop("_doc"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"), spark)
