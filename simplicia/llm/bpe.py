"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can be the last of its encoding. A suffix automaton of
the vocabulary lists the tokens that end at a position, longest first; a candidate is the one if the token stored
for the prefix before it may stand beside it, that is if merging would keep the border between the two. Following
the stored tokens back from the end gives the ids. Nothing is merged step by step, and the work for a piece grows
with its length only.

The automaton is built once, on the driver, as a few megabytes of numpy arrays that depend on the vocabulary alone,
and goes to the executors as one broadcast variable. A task cuts an Arrow batch into pieces by character classes,
takes the distinct ones and advances all of them by one byte at a time, so the interpreter sees a batch, not a byte.

Documents are independent: one Arrow pass, no shuffle. A null or empty text gives no ids. Repeated rows give
equal rows; extra columns are not read. A piece is one word, number, run of signs or run of blanks, so a text is
whole however long it is.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm.common import RUN_BYTES, bounded_batches, chunked, give_back, raw_texts, sliced, spans, table

#: Slots (a power of two) of a worker's cache of pairs of tokens; it bounds memory only.
PAIR_SLOTS = 1 << 18
#: Bytes of a piece beyond which it isn't advanced beside the others but alone, on plain dictionaries.
LONG = 512
#: ids that are spelled at once, unless one text has more; it bounds memory only.
RUN_IDS = 1 << 17
#: Fixed values of byte-level BPE: the classes of characters that it cuts by, and what may follow an apostrophe. A
#: piece is a contraction, or a run of one class with one space before it; of a run of white space before something
#: else the last character is left to the next piece.
LETTER, NUMBER, SPACE = 1, 2, 3
CLASSES = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", SPACE: r"\s+"}
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the
    others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    found = np.zeros(0x110000, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, last)))
        for kind, pattern in CLASSES.items():
            for m in regex.finditer(pattern, every):
                found[first + m.start() : first + m.end()] = kind
    return found


class SuffixAutomaton:
    """Generalised suffix automaton of a set of byte strings, built over their trie level by level."""

    def __init__(self, strings):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        trie: list[dict[int, int]] = [{}]
        for s in strings:
            at = 0
            for b in s:
                nxt = trie[at].get(b)
                if nxt is None:
                    nxt = trie[at][b] = len(trie)
                    trie.append({})
                at = nxt
        level = [(0, 0)]
        while level:
            below = []
            for node, state in level:
                for b, child in trie[node].items():
                    below.append((child, self._extend(state, b)))
            level = below

    def _extend(self, last: int, b: int) -> int:
        step, link, length = self.step, self.link, self.length
        if b in step[last]:
            q = step[last][b]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, b)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and b not in step[p]:
            step[p][b] = new
            p = link[p]
        if p >= 0:
            q = step[p][b]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, b)
        return new

    def _clone(self, p: int, q: int, b: int) -> int:
        step, link, length = self.step, self.link, self.length
        twin = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and step[p].get(b) == q:
            step[p][b] = twin
            p = link[p]
        return twin

    def state_of(self, s: bytes) -> int:
        at = 0
        for b in s:
            at = self.step[at][b]
        return at


class Lookup:
    """Values by non-negative integer keys, for whole arrays of keys at once; -1 where there is none."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        self.shift = np.uint64(62 - max(4, len(keys)).bit_length())
        self.mask = (1 << int(64 - self.shift)) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = left[self.keys[at[left]] == -1]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[first]], values[free[first]]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys):
        at = self._home(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at = (at[left] if len(at) != len(left) else at) + 1 & self.mask
            there = self.keys[at]
            hit = there == keys[left]
            found[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != -1)
            left, at = left[on], at[on]
        return found


@dataclass
class PrefixCoder:
    """Encoder and decoder for one byte-level vocabulary, all in numpy arrays."""

    steps: Lookup  # state * 256 + byte -> state
    link: np.ndarray
    length: np.ndarray
    longest: np.ndarray  # by state: the longest token that ends there
    shorter: np.ndarray  # by token: the longest token that is a proper suffix of it
    size: np.ndarray  # by token: its bytes
    halves: np.ndarray  # by token: the two that merge to it
    merges: Lookup  # left << 20 | right -> token
    id_of: np.ndarray
    added: dict[bytes, int]
    spelled: np.ndarray  # bytes of all ids, one after the other
    spelled_at: np.ndarray  # by id: where its bytes begin; one more for the end
    classes: np.ndarray
    pairs: np.ndarray | None = field(default=None, repr=False)
    plain: tuple | None = field(default=None, repr=False)

    @classmethod
    def of(cls, spec: str) -> PrefixCoder:
        """From the text of the tokenizer's JSON file."""
        data = json.loads(spec)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {as_bytes(k): v for k, v in data["model"]["vocab"].items()}
        # inner numbers: 0-255 the bytes, then merges in their order, so a smaller number merges earlier
        halves, number, merged = [(i, i) for i in range(256)], {bytes([i]): i for i in range(256)}, {}
        for pair in data["model"]["merges"]:
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            if a + b not in number:
                number[a + b] = len(halves)
                halves.append((number[a], number[b]))
            merged[number[a], number[b]] = number[a + b]
        auto = SuffixAutomaton(number)
        ends: dict[int, list[tuple[int, int]]] = {}
        for s, token in number.items():
            ends.setdefault(auto.state_of(s), []).append((len(s), token))
        longest, shorter = [-1] * len(auto.step), [-1] * len(number)
        for at in sorted(range(1, len(auto.step)), key=auto.length.__getitem__):
            longest[at] = longest[auto.link[at]]
            for _, token in sorted(ends.get(at, ())):
                shorter[token], longest[at] = longest[at], token
        added = {t["content"].encode(): t["id"] for t in data.get("added_tokens", [])}
        spelled = {v: k for k, v in vocab.items()} | {v: k for k, v in added.items()}
        by_id = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        return cls(
            Lookup([s << 8 | b for s, step in enumerate(auto.step) for b in step], [q for step in auto.step for q in step.values()]),
            np.array(auto.link, np.int32), np.array(auto.length, np.int32), np.array(longest, np.int32), np.array(shorter, np.int32), np.array([len(s) for s in number], np.int32),
            np.array(halves, np.int32), Lookup([a << 20 | b for a, b in merged], list(merged.values())), np.array([vocab.get(s, -1) for s in number], np.int32), added,
            np.frombuffer(b"".join(by_id), np.uint8), np.cumsum([0, *map(len, by_id)]), character_classes(),
        )

    def _beside(self, left, right):
        """Whether no merge would cross the border between two tokens that stand side by side, for arrays of pairs.

        The two are taken apart from the border outwards, latest merge first; at every stage the pieces that
        touch at the border must not form a token that would have been merged before the stage ended."""
        left, right = left.copy(), right.copy()
        verdict, on = np.ones(len(left), bool), np.arange(len(left))
        until = np.full(len(left), len(self.halves), np.int32)
        while len(on):
            x, y = left[on], right[on]
            together = self.merges.get(x.astype(np.int64) << 20 | y)
            crossed = (together >= 0) & (together < until[on])
            verdict[on[crossed]] = False
            more = ~crossed & ((x >= 256) | (y >= 256))
            on, x, y = on[more], x[more], y[more]
            of_left = (x > y) | ((y < 256) & (x >= 256))
            # of two equal merges the left one comes first: a merge as early as the right part's still loses
            until[on] = np.where(of_left, x, y + 1)
            left[on] = np.where(of_left, self.halves[x, 1], x)
            right[on] = np.where(of_left, y, self.halves[y, 0])
        return verdict

    def compatible(self, left, right):
        """_beside by way of the cache; left is -1 at the start of a piece, where everything fits."""
        if self.pairs is None:
            self.pairs = np.full(PAIR_SLOTS, -1, np.int64)
        key = np.maximum(left, 0).astype(np.int64) << 20 | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - PAIR_SLOTS.bit_length())).astype(np.int64)
        known = self.pairs[at]
        new = np.flatnonzero((known >> 1 != key) & (left >= 0))
        if len(new):
            known[new] = key[new] << 1 | self._beside(left[new], right[new])
            self.pairs[at[new]] = known[new]
        return (left < 0) | (known & 1 == 1)

    def _tables(self):
        """Transitions, merges and known pairs as dictionaries and the arrays as lists, for pieces that go alone."""
        if self.plain is None:
            there = self.steps.keys >= 0
            steps = dict(zip(self.steps.keys[there].tolist(), self.steps.values[there].tolist(), strict=True))
            there = self.merges.keys >= 0
            merges = dict(zip(self.merges.keys[there].tolist(), self.merges.values[there].tolist(), strict=True))
            self.plain = steps, merges, {}, self.halves.tolist(), *(a.tolist() for a in (self.link, self.length, self.longest, self.shorter, self.size, self.id_of))
        return self.plain

    def encode_long(self, piece: bytes) -> list[int]:
        """ids of one piece, a byte at a time: what encode_pieces does for many, where there is only one to go on with."""
        steps, merges, known, halves, link, length, longest, shorter, size, id_of = self._tables()

        def beside(x, y):
            until = len(halves)
            while True:
                together = merges.get(x << 20 | y)
                if together is not None and together < until:
                    return False
                if x < 256 and y < 256:
                    return True
                if x > y or y < 256:
                    until, x = x, halves[x][1]
                else:
                    until, y = y + 1, halves[y][0]

        if len(known) > PAIR_SLOTS:
            known.clear()
        last = [-1] * (len(piece) + 1)
        state = matched = 0
        for i, byte in enumerate(piece, 1):
            after = steps.get(state << 8 | byte)
            while after is None:
                state = link[state]
                matched = length[state]
                after = steps.get(state << 8 | byte)
            state, matched = after, matched + 1
            token = longest[state]
            while True:
                n = size[token]
                if n <= matched:
                    left = last[i - n]
                    if left < 0:
                        break
                    key = left << 20 | token
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = beside(left, token)
                    if fits:
                        break
                token = shorter[token]
            last[i] = token
        out, at = [], len(piece)
        while at:
            out.append(id_of[last[at]])
            at -= size[last[at]]
        return out[::-1]

    def encode_pieces(self, data, begin, sizes):
        """ids of all pieces, one after the other, and how many each has. Pieces beyond LONG bytes go alone."""
        far = np.flatnonzero(sizes > LONG)
        if not len(far):
            return self._encode_together(data, begin, sizes)
        near = np.flatnonzero(sizes <= LONG)
        ids, n = self._encode_together(data, begin[near], sizes[near])
        alone = [np.array(self.encode_long(data[begin[k] : begin[k] + sizes[k]].tobytes()), np.int32) for k in far]
        counts = np.empty(len(sizes), np.int32)
        counts[near], counts[far] = n, [len(a) for a in alone]
        first = np.cumsum(counts, dtype=np.int64) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[np.repeat(first[near] - (np.cumsum(n, dtype=np.int64) - n), n) + np.arange(len(ids))] = ids
        for k, a in zip(far, alone, strict=True):
            out[first[k] : first[k] + len(a)] = a
        return out, counts

    def _encode_together(self, data, begin, sizes):
        """The pieces go on by one byte a step, the longest first in order, so that those still going on are the first ones."""
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        base = np.cumsum(sizes + 1) - (sizes + 1)
        last = np.full(int((sizes + 1).sum()), -1, np.int32)
        used = np.zeros(len(last), np.int32)
        state, matched = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        going = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if len(sizes) else 0) + 1), side="right")
        for i, n in enumerate(going.tolist(), 1):
            byte, now, reach, here = data[begin[:n] + (i - 1)].astype(np.int64), state[:n], matched[:n], base[:n] + i
            after = self.steps.get(now.astype(np.int64) << 8 | byte)
            lost = np.flatnonzero(after < 0)
            while len(lost):
                up = self.link[now[lost]]
                now[lost], reach[lost] = up, self.length[up]
                after[lost] = self.steps.get(up.astype(np.int64) << 8 | byte[lost])
                lost = lost[after[lost] < 0]
            now[:] = after
            reach += 1
            token, open_ = self.longest[after], np.arange(n)
            while len(open_):
                t = token[open_]
                size = self.size[t]
                fits = size <= reach[open_]
                short = np.flatnonzero(fits)
                fits[short] = self.compatible(last[here[open_[short]] - size[short]], t[short])
                open_ = open_[~fits]
                token[open_] = self.shorter[t[~fits]]
            last[here] = token
            used[here] = used[here - self.size[token]] + 1
        at, counts = sizes.astype(np.int64), used[base + sizes]
        out = np.empty(int(counts.sum()), np.int32)
        by_piece = np.empty(len(order), np.int32)
        by_piece[order] = counts
        place = (np.cumsum(by_piece, dtype=np.int64) - 1)[order]
        on = np.flatnonzero(at > 0)
        while len(on):
            t = last[base[on] + at[on]]
            out[place[on]] = self.id_of[t]
            place[on] -= 1
            at[on] -= self.size[t]
            on = on[at[on] > 0]
        return out, by_piece

    def cut(self, joined: bytes, sizes):
        """Where the pieces of texts that stand one after the other begin (bytes), given the texts' sizes."""
        raw = np.frombuffer(joined, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64)
        if joined.isascii():
            points, at = raw, None
        else:
            points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
            at = np.flatnonzero((raw & 0xC0) != 0x80)
        n = len(points)
        first = np.zeros(n + 3, bool)  # of a text; as if one began behind the end
        begin = np.cumsum(sizes) - sizes
        begin = begin[sizes > 0]
        first[begin if at is None else np.searchsorted(at, begin)] = True
        first[n:] = True
        kind = np.zeros(n + 3, np.uint8)
        kind[:n] = self.classes[points]
        start = first.copy()
        start[1:n] |= kind[1:n] != kind[: n - 1]
        before = np.flatnonzero((kind[:n] == SPACE) & (kind[1 : n + 1] != SPACE) & ~first[1 : n + 1])
        start[before] = True
        start[before[points[before] == 32] + 1] = False
        quotes = np.flatnonzero((points == 39) & start[:n] & ~first[1 : n + 1])
        for letters in CONTRACTIONS:
            if len(quotes):
                there, size = quotes[quotes + len(letters) < n], len(letters)
                for k, c in enumerate(letters, 1):
                    there = there[(points[there + k] == ord(c)) & ~first[there + k]]
                start[there + 1] = False
                start[there + 1 + size] = True
        found = np.flatnonzero(start[:n])
        return found if at is None else at[found]

    def cut_runs(self, parts: list[bytes], sizes):
        """cut of any number of texts, a run of them at a time: no piece goes beyond its text, and what cut holds is many
        times its bytes."""
        found, done = [np.zeros(0, np.int64)], 0
        for i, j in chunked(parts, RUN_BYTES):
            found.append(self.cut(b"".join(parts[i:j]), sizes[i:j]) + done)
            done += int(sizes[i:j].sum())
        return np.concatenate(found)

    def encode_texts(self, texts: list[bytes]):
        """ids of all texts, one after the other, and where each begins (one more for the end)."""
        import pyarrow as pa

        parts, owner, special = texts, None, {}
        if any(any(a in t for t in texts) for a in self.added):
            parts, owner, special = self._around_added(texts)
        joined = b"".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = self.cut_runs(parts, sizes)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(joined)).astype(np.int64)), pa.py_buffer(joined)])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        offsets, data = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1], coded.dictionary.buffers()[2]
        ids, counts = self.encode_pieces(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets))
        flat = spans(ids, (np.cumsum(counts, dtype=np.int64) - counts)[codes], counts[codes])
        ends = np.append(0, np.cumsum(counts[codes], dtype=np.int64))
        borders = ends[np.searchsorted(begin, np.append(0, np.cumsum(sizes)))]
        if owner is None:
            return flat, borders
        out: list[list] = [[] for _ in texts]
        for k, i in enumerate(owner):
            out[i].append([special[k]] if k in special else flat[borders[k] : borders[k + 1]])
        whole = [np.concatenate([np.asarray(x, np.int32) for x in one]) if one else np.zeros(0, np.int32) for one in out]
        return np.concatenate(whole), np.cumsum([0, *map(len, whole)])

    def _around_added(self, texts: list[bytes]):
        """Texts cut at added tokens: the parts, the text of each, and the id of those that are such a token (as
        empty parts)."""
        import re

        at_added = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")").split
        parts, owner, special = [], [], {}
        for i, text in enumerate(texts):
            for k, part in enumerate(at_added(text)):
                if k % 2:
                    special[len(parts)] = self.added[part]
                parts.append(b"" if k % 2 else part)
                owner.append(i)
        return parts, owner, special

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text.encode()])[0].tolist()

    def decode_texts(self, ids, borders) -> list[bytes]:
        """The texts in UTF-8; what isn't valid becomes U+FFFD. Runs of texts of up to RUN_IDS ids are spelled at once."""
        size_of, found, i = np.diff(self.spelled_at), [], 0
        while i < len(borders) - 1:
            j = max(i + 1, int(np.searchsorted(borders, borders[i] + RUN_IDS, side="right")) - 1)
            run = ids[borders[i] : borders[j]]
            sizes = size_of[run]
            raw = spans(self.spelled, self.spelled_at[run], sizes).tobytes()
            ends = np.append(0, np.cumsum(sizes))[borders[i : j + 1] - borders[i]].tolist()
            found += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            i = j
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in found]


def _coder(vocabulary: str) -> PrefixCoder:
    return PrefixCoder.of(open(vocabulary, encoding="utf-8").read())


def _broadcast(spark: SparkSession, vocabulary: str):
    """The coder for the tasks. The driver keeps neither it nor what its making took."""
    shared = spark.sparkContext.broadcast(_coder(vocabulary))
    give_back()
    return shared


def _coded(docs: DataFrame, vocabulary: str, text: str, keep: list[str], schema, columns) -> DataFrame:
    """keep of docs, and columns(raw texts, ids, borders, coder) as Arrow arrays behind them."""
    bounded_batches(docs.sparkSession)
    shared = _broadcast(docs.sparkSession, vocabulary)

    def run(batches):
        import pyarrow as pa

        coder = shared.value
        for batch in sliced(batches):
            raws = [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in raw_texts(batch.column(batch.schema.get_field_index(text)))]
            for i, j in chunked(raws):
                ids, borders = coder.encode_texts(raws[i:j])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in keep), *columns(raws[i:j], ids, borders, coder)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _lists(ids, borders):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32()))


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs plus ids array<int> and decoded string (columns of docs with those names are replaced). vocabulary: path
    of the tokenizer's JSON file, on the driver."""
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = StructType([*kept, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return _coded(docs, vocabulary, text, [f.name for f in kept], schema, lambda raws, ids, borders, coder: [_lists(ids, borders), _strings(coder.decode_texts(ids, borders))])


def _strings(raws: list[bytes]):
    import pyarrow as pa

    return pa.array(raws, pa.binary()).cast(pa.string())


def encoded(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs, n_tokens, ids and round_trip, whether decoding gives the text back. The text and the
    decoded text stay inside the tasks."""
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    schema = StructType([*(docs.schema[n] for n in keep), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])

    def columns(raws, ids, borders, coder):
        import pyarrow as pa

        back = coder.decode_texts(ids, borders)
        return [pa.array(np.diff(borders), pa.int64()), _lists(ids, borders), pa.array([x == y for x, y in zip(raws, back, strict=True)], pa.bool_())]

    return _coded(docs, vocabulary, text, keep, schema, columns)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; the ids stay inside the tasks."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def columns(raws, ids, borders, coder):
        import pyarrow as pa

        raw, at = ids.astype("<u4").tobytes(), (borders * 4).tolist()
        return [
            pa.array(np.diff(borders), pa.int64()),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in coder.decode_texts(ids, borders)], pa.string()),
        ]

    return _coded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), vocabulary, "text", ["doc_id"], schema, columns)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), default_vocabulary())
