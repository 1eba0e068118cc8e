"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The tokenizer file names the merges and the normalisation: NFC, white space to one space,
lower case, then words by the file's pattern; bytes as characters, the last one with the end-of-word mark. The operator

1. counts the words of all texts (combined per task, then by Spark) and takes the most frequent ones, at most
   ``LEXICON`` (a whole number of frequency classes, found from the histogram of the counts). No word reaches across white
   space, so texts are split there first, and only the distinct pieces of some megabytes are cut into words: those of plain
   ASCII by the kind of their bytes, the others by the pattern;
2. encodes these in tasks and compiles them on the driver, which they fit by that bound, into a minimal acyclic
   automaton: equal suffixes share their states, and the outputs of the arcs on a word's path
   add up to the word's number, which indexes its ids. The file is sent with ``addFile`` and memory-mapped by every worker;
3. encodes each text: the distinct words of the distinct pieces of some megabytes walk through the automaton together, one byte
   at a time; words it does not accept are merged exactly (rank by rank, long ones with a heap). Pieces, words and ids stay in Arrow
   and numpy arrays from the text to the digests.

Ids are those of the tokenizers library with add_special_tokens=False: strings of special tokens in a
text get their ids. Decoding joins the tokens with a space, as a file without a decoder asks for.

Null and empty texts have no ids and decode to the empty string. Rows are independent; a word of any length
is merged in O(n log n); other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import textcols as tc
from cohortlens.llm.tables import beside, pick, ship, table

#: words in the lexicon at most (about 60 bytes each in the file)
LEXICON = 100_000
#: bytes of texts whose pieces, words and ids a worker holds at once
CHUNK = 1 << 20
#: bytes of a word that is merged together with others; longer ones have a heap of their own
SHORT = 64

# Unicode's White_Space, and the byte characters of byte-level BPE (printable bytes as themselves).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Letters and digits that the regex module knows but Unicode 16, the tokenizers library's version, leaves unassigned (hexadecimal ranges).
NEWER_RANGES = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 "
    "1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff "
    "2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
NEWER = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER_RANGES.split())
# Lower case of capitals that are newer than this Python's tables (code points).
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
               **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
#: the pattern whose words in plain ASCII are runs of letters, single digits and runs of the rest, but for apostrophes
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
#: ``str.split`` parts at these too, though they are no white space
NOT_SPACE = re.compile("[\x1c-\x1f]")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_chars() -> list[str]:
    out = [""] * 256
    for b in PRINTABLE:
        out[b] = chr(b)
    spare = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


def _lower(text: str) -> str:
    """NFC and lower case of each character, whatever stands beside it."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(NEWER_LOWER)


class Merges:
    """What a tokenizer file says: words of a text, exact ids of a word, tokens of ids. Tasks get it as arrays: a worker neither
    parses the file nor holds its merges as Python objects, unless a long word needs them."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.mark = model["end_of_word_suffix"]
        chars = byte_chars()
        self.plain = [vocab[c] for c in chars]
        self.last = [vocab[c + self.mark] for c in chars]
        name = {v: k for k, v in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        name.update({v: k for k, v in self.special.items()})
        self.tokens = pa.array([name.get(i, "") for i in range(max(name) + 1)], pa.large_string())
        pair = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # as arrays: a pair as one key, ascending, with its rank and what it becomes
        keys = np.array([a << 32 | b for a, b in pair], np.int64)
        rank, new = (np.array([v[j] for v in pair.values()], np.int64) for j in range(2))
        order = np.argsort(keys)
        self.by_key = keys[order], rank[order].astype(np.int32), new[order].astype(np.int32)
        self.own = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._compile()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("mark", "plain", "last", "special", "tokens", "by_key", "own")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._compile()

    def _compile(self) -> None:
        own = self.own
        # bytes of pieces that are left to the pattern
        self.by_pattern = np.full(256, own != PATTERN)
        self.by_pattern[[ord("'"), *range(128, 256), *(s.encode()[0] for s in self.special)]] = True
        pattern = own.replace(r"\s", SPACE)
        ascii_, exact = pattern, pattern
        for kind, few in ((r"\p{L}", "[a-zA-Z]"), (r"\p{N}", "[0-9]")):
            ascii_ = ascii_.replace(kind, few)
            exact = exact.replace(kind, f"[{kind}--[{NEWER}]]")
        self.find = regex.compile(exact, regex.V1).findall
        # for many pieces at once, which a new line parts; the plain classes do for ASCII, and without newer letters
        self.find_ascii, self.find_plain, self.find_all = (regex.compile(x + "|\n", regex.V1).findall for x in (ascii_, pattern, exact))
        self.newer = regex.compile(f"[{NEWER}]").search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.marks = tuple({s[:2] for s in self.special})
        self.spaced = any(c in s for s in self.special for c in SPACE)
        self.space = regex.compile(f"[{SPACE}]+")

    @cached_property
    def pair(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, what it becomes) of each pair."""
        keys, rank, new = (x.tolist() for x in self.by_key)
        return {(k >> 32, k & 0xFFFFFFFF): (r, to) for k, r, to in zip(keys, rank, new)}

    def pieces(self, text: str) -> list[str]:
        """The text cut at white space: no word reaches across it."""
        if self.spaced:
            raise ValueError("special tokens with white space are not supported")
        if NOT_SPACE.search(text):
            return [x for x in self.space.split(text) if x]
        return text.split()

    def words_of(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece; pieces hold no new line."""
        out: list[list[str]] = [[]] * len(pieces)
        plain, other = [], []
        for i, x in enumerate(pieces):
            for m in self.marks:
                if m in x:
                    out[i] = self.words(x)
                    break
            else:
                (plain if x.isascii() else other).append(i)
        for at, lower in ((plain, str.lower), (other, _lower)):
            if at:
                text = lower("\n".join([pieces[i] for i in at]))
                find = self.find_ascii if at is plain else self.find_all if self.newer(text) else self.find_plain
                mine: list[str] = []
                places = iter(at)
                for w in find(text):
                    if w == "\n":
                        out[next(places)] = mine
                        mine = []
                    else:
                        mine.append(w)
                out[next(places)] = mine
        return out

    def words(self, text: str) -> list[str]:
        if any(m in text for m in self.marks):
            out = []
            for k, part in enumerate(self.cut.split(text)):
                if k % 2:
                    out.append(part)
                else:
                    out += self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        return self.find(text.lower() if text.isascii() else _lower(text))

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        raw = word.encode()
        out = [self.plain[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        pair = self.pair
        n = len(out)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = pair.get((out[i], out[i + 1]))
            if m:
                heap.append((m[0], i, m[1], out[i], out[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if out[i] != a or j >= n or out[j] != b:
                continue
            out[i], out[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                m = pair.get((new, out[right[i]]))
                if m:
                    heapq.heappush(heap, (m[0], i, m[1], new, out[right[i]]))
            if left[i] >= 0:
                m = pair.get((out[left[i]], new))
                if m:
                    heapq.heappush(heap, (m[0], left[i], m[1], out[left[i]], new))
        return [x for x in out if x >= 0]


    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Exact ids of many words."""
        flat, size = self.merged(pa.array(words, pa.large_string()))
        flat, stop = flat.tolist(), np.cumsum(size).tolist()
        return [flat[a:z] for a, z in zip([0, *stop], stop)]

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of many words, one after the other, and how many each has: in each round every word merges its pair of
        least rank, the first of equal ones."""
        data, off, _ = tc.string_parts(words)
        size = np.diff(off)
        alone = size > SHORT
        for s in self.special:
            alone |= np.asarray(pc.equal(words, pa.scalar(s, words.type)))
        count = np.zeros(len(words), np.int64)
        ended = []
        for i in np.flatnonzero(alone).tolist():
            x = self.ids(words[i].as_py())
            count[i] = len(x)
            ended.append((np.full(len(x), i, np.int32), np.array(x, np.int32)))
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        sym = np.array(self.plain, np.int32)[data]
        last = off[1:][size > 0] - 1
        sym[last] = np.array(self.last, np.int32)[data[last]]
        some = ~alone[word]
        word, sym = word[some], sym[some]
        none = len(self.by_key[0])
        rank, to = self._pairs(word, sym, np.arange(len(word)))
        while len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            n = np.diff(first, append=len(word))
            least = np.minimum.reduceat(rank, first)
            over = least == none
            if over.any():
                gone = np.repeat(over, n)
                ended.append((word[gone], sym[gone]))
                word, sym, rank, to = (x[~gone] for x in (word, sym, rank, to))
                least, n = least[~over], n[~over]
            place = np.flatnonzero(rank == np.repeat(least, n))
            place = place[np.flatnonzero(np.diff(word[place], prepend=-1))]
            sym[place] = to[place]
            keep = np.ones(len(word), bool)
            keep[place + 1] = False
            word, sym, rank, to = (x[keep] for x in (word, sym, rank, to))
            place -= np.arange(len(place))
            place = np.concatenate([place, place[place > 0] - 1])
            rank[place], to[place] = self._pairs(word, sym, place)
        word, sym = (np.concatenate([np.zeros(0, np.int32), *(e[j] for e in ended)]) for j in range(2))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _pairs(self, word: np.ndarray, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, what it becomes) of the pairs that begin at ``at``; pairs that don't merge have the rank after the last."""
        key_, rank_, new_ = self.by_key
        if not len(key_) or not len(at):
            return np.full(len(at), len(key_), np.int32), np.zeros(len(at), np.int32)
        after = np.minimum(at + 1, len(word) - 1)
        want = sym[at].astype(np.int64) << 32 | sym[after]
        found = np.minimum(np.searchsorted(key_, want), len(key_) - 1)
        ok = (key_[found] == want) & (word[at] == word[after]) & (after > at)
        return np.where(ok, rank_[found], np.int32(len(key_))), new_[found]

    def all_words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of pieces without ASCII white space: all of them, where those of each piece begin, and how many it has."""
        data, off, _ = tc.string_parts(pieces)
        hard = np.zeros(len(pieces), bool)
        hard[np.searchsorted(off, np.flatnonzero(self.by_pattern[data]), "right") - 1] = True
        data, off, _ = tc.string_parts(pieces.filter(pa.array(~hard)))
        kind = KIND[data]
        start = np.ones(len(data), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start[off[:-1][off[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        easy = _strings(tc.LOWER[data], np.append(at, len(data)))
        other = self.words_of(pieces.filter(pa.array(hard)).to_pylist())
        count = np.zeros(len(pieces), np.int64)
        count[~hard] = np.diff(np.searchsorted(at, off))
        count[hard] = [len(ws) for ws in other]
        begin = np.zeros(len(pieces), np.int64)
        begin[~hard] = np.cumsum(count[~hard]) - count[~hard]
        begin[hard] = len(at) + np.cumsum(count[hard]) - count[hard]
        return pa.concat_arrays([easy, pa.array([w for ws in other for w in ws], pa.large_string())]), begin, count


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, as arrays; arc outputs add up to the word's number."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []
    final: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(arcs)
            arcs.append(key[1])
            final.append(key[0])
        return at

    path: list[list] = [[False, []]]
    before = b""
    for word, _ in entries:
        same = 0
        for x, y in zip(before, word):
            if x != y:
                break
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(node)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((before[len(path) - 1], settle(node)))
    root = settle(path[0])
    size = [0] * len(arcs)  # words from each state; children are settled before their parents
    key, to, add = [], [], []
    for s, own in enumerate(arcs):
        n = int(final[s])
        for b, child in own:
            key.append(s * 256 + b)
            to.append(child)
            add.append(n)
            n += size[child]
        size[s] = n
    return {
        "key": np.array(key, np.int64), "to": np.array(to, np.int32), "add": np.array(add, np.int32),
        "final": np.array(final, np.uint8), "root": np.array([root], np.int64),
        "at": np.concatenate([[0], np.cumsum([len(x) for _, x in entries])]).astype(np.int64),
        "ids": np.array([i for _, x in entries for i in x], np.int32),
    }


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    head = json.dumps({k: [str(v.dtype), len(v)] for k, v in arrays.items()}).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            f.write(b"\0" * (-f.tell() % 8) + v.tobytes())


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of ``save``, memory-mapped: workers of a machine share the pages."""
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    out, at = {}, 8 + n
    for k, (kind, size) in head.items():
        at += -at % 8
        out[k] = np.memmap(path, np.dtype(kind), "r", at, (size,)) if size else np.zeros(0, kind)
        at += size * np.dtype(kind).itemsize
    return out


def look_up(lex: dict[str, np.ndarray], words: list[bytes] | pa.Array) -> np.ndarray:
    """The number of each word in the lexicon, or -1: all words take their next byte together."""
    number = np.zeros(len(words), np.int64)
    if not len(lex["key"]) or not len(words):
        return np.full(len(words), -1, np.int64)
    data, off, _ = tc.string_parts(words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary()).cast(pa.large_string()))
    begin, size = off[:-1], np.diff(off)
    state = np.full(len(words), int(lex["root"][0]), np.int64)
    live = np.arange(len(words))
    key, to, add = lex["key"], lex["to"], lex["add"]
    step = 0
    while len(live):
        live = live[size[live] > step]
        if not len(live):
            break
        want = state[live] * 256 + data[begin[live] + step]
        arc = np.minimum(np.searchsorted(key, want), len(key) - 1)
        ok = key[arc] == want
        state[live[~ok]] = -1
        live, arc = live[ok], arc[ok]
        state[live] = to[arc]
        number[live] += add[arc]
        step += 1
    good = state >= 0
    good[good] = lex["final"][state[good]] == 1
    return np.where(good, number, -1)


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _stops(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


def _joined(rows: pa.Array, off: np.ndarray) -> pa.Array:
    """Stretches of strings, each joined by a space."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), rows), pa.scalar(" ", rows.type))


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of texts cut at ASCII white space, which of them stand in the texts, and where each text's begin."""
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), _stops(np.asarray(pc.list_value_length(parts)))


class Encoded:
    """Ids of some texts: of their distinct pieces, and which pieces each text has."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, which: np.ndarray, bounds: np.ndarray):
        some = np.diff(off)[which] > 0  # pieces without a word have no place in the decoded text
        self.ids, self.off, self.which, self.bounds = ids, off, which[some], _stops(some)[bounds]

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin."""
        size = np.diff(self.off)[self.which]
        return self.ids[_runs(self.off[self.which], size)], _stops(size)[self.bounds]

    def decoded(self, tokens: pa.Array) -> pa.Array:
        return _joined(_joined(tokens.take(pa.array(self.ids)), self.off).take(pa.array(self.which)), self.bounds)


class Encoder:
    def __init__(self, merges: Merges, lex: dict[str, np.ndarray]):
        self.merges, self.lex = merges, {k: np.asarray(v) for k, v in lex.items()}
        self.tokens = merges.tokens

    def encode(self, texts: list[str] | pa.Array) -> tuple[list[np.ndarray], Encoded]:
        """Ids of each text, and what they decode to."""
        if self.merges.spaced:
            raise ValueError("special tokens with white space are not supported")
        pieces, which, bounds = pieces_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        words, begin, count = self.merges.all_words(pieces)
        words = words.dictionary_encode()
        number = look_up(self.lex, words.dictionary)
        unseen = number < 0
        ids, size = self.merges.merged(words.dictionary.filter(pa.array(unseen)))
        at, flat = self.lex["at"], self.lex["ids"]
        start, n = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        start[~unseen], n[~unseen] = at[number[~unseen]], np.diff(at)[number[~unseen]]
        start[unseen], n[unseen] = len(flat) + np.cumsum(size) - size, size
        in_pieces = np.asarray(words.indices)[_runs(begin, count)]
        ids = np.concatenate([flat, ids])[_runs(start[in_pieces], n[in_pieces])]
        out = Encoded(ids, _stops(n[in_pieces])[_stops(count)], which, bounds)
        flat, off = out.flat()
        return [flat[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist())], out


def _texts(c: tc.Chunk) -> pa.Array:
    return _strings(c.data, c.off)


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]):
        merges = sent.value
        special = pa.array(list(merges.special), pa.large_string())

        def out(texts: list[pa.Array]):
            pieces, which, _ = pieces_of(pa.concat_arrays(texts))
            words, begin, count = merges.all_words(pieces)
            coded = words.dictionary_encode()
            times = np.repeat(np.bincount(which, minlength=len(pieces)), count)
            n = np.bincount(np.asarray(coded.indices)[_runs(begin, count)], times, len(coded.dictionary)).astype(np.int64)
            rows = pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n)], names=["word", "n"])
            return rows.filter(pc.invert(pc.is_in(coded.dictionary, special)))

        texts, size = [], 0
        for c in tc.chunks(batches, size=CHUNK):
            texts.append(_texts(c))
            size += len(c.data)
            if size >= CHUNK // 2:
                yield out(texts)
                texts, size = [], 0
                tc.give_back()
        if texts:
            yield out(texts)
    return run


def _ids_of(sent):
    def run(batches):
        merges = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(merges.ids_of(b.column(0).to_pylist()), pa.list_(pa.int32()))], names=["word", "ids"])
    return run


class Codec:
    """A tokenizer file and a lexicon of a corpus' frequent words, ready for Spark tasks."""

    def __init__(self, docs: DataFrame, path: str, text_col: str = "text", lexicon: int = LEXICON):
        spark = docs.sparkSession
        ship(spark)
        with open(path, encoding="utf-8") as f:
            self.merges = spark.sparkContext.broadcast(Merges(json.load(f)))
        src = docs.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        counts = src.mapInArrow(_count(self.merges), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
        # the histogram of counts has few rows (about the square root of the words at most)
        least, kept = None, 0
        for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            if kept + r["count"] > lexicon:
                break
            least, kept = r["n"], kept + r["count"]
        entries = []
        if least is not None:
            frequent = counts.filter(F.col("n") >= least).select("word")
            entries = [(r["word"].encode(), list(r["ids"])) for r in frequent.mapInArrow(_ids_of(self.merges), "word string, ids array<int>").toLocalIterator()]
        counts.unpersist()
        entries.sort()
        self.words = len(entries)
        self.name = f"lexicon-{uuid.uuid4().hex}.bin"
        file = os.path.join(tempfile.mkdtemp(prefix="cohortlens-lex-"), self.name)
        save(compile_lexicon(entries), file)
        spark.sparkContext.addFile(file)

    def _encoder(self):
        merges, name = self.merges, self.name

        def make() -> Encoder:
            return Encoder(merges.value, load(SparkFiles.get(name)))

        return make

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id_col, ids) of every row."""
        make = self._encoder()
        src = pick(docs, row=id_col, text=text_col).select("row", F.col("text").cast("string").alias("text"))

        def run(batches):
            enc = make()
            for c in tc.chunks(batches, size=CHUNK):
                yield pa.RecordBatch.from_arrays([c.cols[0], pa.array(enc.encode(_texts(c))[0], pa.list_(pa.int32()))], names=["row", "ids"])

        return src.mapInArrow(run, beside(src, "row", "ids array<int>")).withColumnRenamed("row", id_col)

    def decode(self, rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """(id_col, text) of rows of ids; a null array decodes to the empty string."""
        merges = self.merges
        src = pick(rows, row=id_col, ids=ids_col)

        def run(batches):
            tokens = merges.value.tokens.to_pylist()
            for b in batches:
                texts = [" ".join([tokens[i] for i in x or ()]) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

        return src.mapInArrow(run, beside(src, "row", "text string")).withColumnRenamed("row", id_col)

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunk: int = CHUNK) -> DataFrame:
        """(id_col, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for: encode and decode in one task, ``chunk`` bytes of texts at a time."""
        make = self._encoder()
        src = pick(docs, row=id_col, text=text_col).select("row", F.col("text").cast("string").alias("text"))

        def run(batches):
            enc = make()
            for c in tc.chunks(batches, size=chunk):
                ids, out = enc.encode(_texts(c))
                a = [hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in ids]
                shown, off, _ = tc.string_parts(out.decoded(enc.tokens))
                b = [hashlib.sha256(shown[i:j]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                cols = [c.cols[0], pa.array([len(x) for x in ids], pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)
                del ids, out, shown, off, a, b, cols
                tc.give_back()

        schema = beside(src, "row", "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
        names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if with_ids else 4]
        return src.mapInArrow(run, schema).withColumnRenamed("row", id_col)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return Codec(docs, path or vocabulary()).digests(docs)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
