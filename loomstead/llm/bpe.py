"""BPE encoding by speculation: greedy proposals, vectorised pair checks, exact merging of the rest."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomstead.llm import text as tx
from loomstead.llm.pretoken import Encoder

#: No merge makes this pair, or nothing takes this token up.
NEVER = 1 << 30
WORD_END = "</w>"
#: Longer words are merged one by one, with a queue.
SHORT_WORD = 64
#: Words whose longest match is sought at a time.
PROPOSALS = 1 << 14
#: Characters that are encoded at a time; a longer text is cut where no pre-token can cross.
PART_CHARS = 1 << 19
#: Before a single space between other characters, every pre-token ends.
_SAFE_CUT = re.compile(r"\S(?= \S)")
#: Rows that are decoded at a time.
DECODE_ROWS = 64
#: From U+0250 on, characters may change under canonical composition; none before do.
_COMPOSABLE = re.compile("[\u0250-\U0010ffff]")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, for code points from 256.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table = {chr(b): b for b in visible}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}


class SpeculativeBPE:
    """A vocabulary whose words end in ``</w>``, encoding many distinct words at once.

    A sequence of self-encoding tokens is what merging yields if and only if no adjacent
    pair would have merged across its border earlier, so pairs can be checked on their own.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, letters = model["vocab"], byte_letters()
        n = max(vocab.values()) + 1
        self.strings = [""] * n
        self.left, self.right, self.rank = (np.full(n, -1, np.int64) for _ in range(3))
        for token, i in vocab.items():
            self.strings[i] = token
        pairs = np.zeros((len(model["merges"]), 2), np.int64)
        for r, (a, b) in enumerate(model["merges"]):
            pairs[r] = vocab[a], vocab[b]
            made = vocab[a + b]
            self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], r
        self.n = n
        order = np.argsort(pairs[:, 0] * n + pairs[:, 1])
        self.pair_key, self.pair_rank = (pairs[:, 0] * n + pairs[:, 1])[order], order
        self.merges = {(a, b): r for r, (a, b) in enumerate(pairs.tolist())}
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.base = {(letters[t.removesuffix(WORD_END)], t.endswith(WORD_END)): i for t, i in vocab.items() if len(t.removesuffix(WORD_END)) == 1}
        self.inner, self.final = (np.array([self.base[b, end] for b in range(256)], np.int64) for end in (False, True))

        spelled = [(bytes(letters[c] for c in t.removesuffix(WORD_END)), t.endswith(WORD_END), i) for t, i in vocab.items()]
        size = np.array([len(b) for b, _, _ in spelled], np.int64)
        self.longest = int(size.max())
        ends, of = np.cumsum(size), np.array([i for _, _, i in spelled])
        self.spelling = np.frombuffer(b"".join(b for b, _, _ in spelled), np.uint8)
        self.spelled_at, self.spelled_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.spelled_at[of], self.spelled_size[of] = ends - size, size
        self.closes = np.zeros(n, bool)
        self.closes[of] = [e for _, e, _ in spelled]
        key = self._key(tx.span_hashes(self.spelling, ends - size, ends), size, self.closes[of])
        order = np.argsort(key)
        self.token_key, self.token_id = key[order], of[order]
        self.sound = self._self_encoding()
        self.seen_pair, self.seen_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    @staticmethod
    def _key(hashes: np.ndarray, size: np.ndarray, final: np.ndarray) -> np.ndarray:
        return tx.mix(hashes + (2 * size + final).astype(np.uint64))

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def _holds(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair, looking back from rank ``until``.

        Undoing the later of the two tokens gives the pair that met at the border before it;
        those two would have merged if their rank came before either was taken up.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y, taken_x, taken_y = a.copy(), b.copy(), until.copy(), until.copy()
        while len(at):
            rank = self._merge_rank(x, y)
            broken = (rank < taken_x) & (rank <= taken_y)
            ok[at[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~broken & ((rx >= 0) | (ry >= 0))
            at, x, y, taken_x, taken_y, rx, ry = (v[go] for v in (at, x, y, taken_x, taken_y, rx, ry))
            undo = rx > ry
            taken_x, taken_y = np.where(undo, rx, taken_x), np.where(undo, taken_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def _self_encoding(self) -> np.ndarray:
        """Tokens that merging their own spelling gives back."""
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.n, bool)
        sound[made] = self._holds(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])].tolist():
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each adjacent pair may stand; verdicts on distinct pairs are kept."""
        key, inverse = np.unique(a * self.n + b, return_inverse=True)
        at = np.searchsorted(self.seen_pair, key)
        inside = at < len(self.seen_pair)
        known = np.zeros(len(key), bool)
        known[inside] = self.seen_pair[at[inside]] == key[inside]
        new = np.flatnonzero(~known)
        if len(new):
            verdict = self._holds(key[new] // self.n, key[new] % self.n, np.full(len(new), NEVER))
            if len(self.seen_pair) > 1_000_000:
                self.seen_pair, self.seen_ok = key[new], verdict
                ok = np.zeros(len(key), bool)
                ok[known], ok[new] = self._holds(key[known] // self.n, key[known] % self.n, np.full(int(known.sum()), NEVER)), verdict
                return ok[inverse]
            self.seen_pair = np.insert(self.seen_pair, at[new], key[new])
            self.seen_ok = np.insert(self.seen_ok, at[new], verdict)
            at = np.searchsorted(self.seen_pair, key)
        return self.seen_ok[at][inverse]

    def _propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words side by side: word number and id, words in order."""
        word, found_word, found_id = np.arange(len(start)), [], []
        at = start.copy()
        while len(word):
            best, size = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
            for low in range(0, len(word), PROPOSALS):
                rows = slice(low, low + PROPOSALS)
                self._longest(data, at[rows], end[word[rows]] - at[rows], best[rows], size[rows])
            found_word.append(word)
            found_id.append(best)
            at = at + size
            more = at < end[word]
            word, at = word[more], at[more]
        words, ids = np.concatenate(found_word), np.concatenate(found_id)
        order = np.argsort(words, kind="stable")
        return words[order], ids[order]

    def _longest(self, data: np.ndarray, at: np.ndarray, left: np.ndarray, best: np.ndarray, size: np.ndarray) -> None:
        """Set the longest token that matches at each place, by hash."""
        hashes = tx.prefix_hashes(data, at, np.minimum(left, self.longest))
        for length in range(hashes.shape[1], 0, -1):
            open_ = np.flatnonzero((best < 0) & (left >= length))
            if not len(open_):
                continue
            key = self._key(hashes[open_, length - 1], np.full(len(open_), length), left[open_] == length)
            i = np.minimum(np.searchsorted(self.token_key, key), len(self.token_key) - 1)
            hit = self.token_key[i] == key
            best[open_[hit]], size[open_[hit]] = self.token_id[i[hit]], length

    def _misspelled(self, data: np.ndarray, owner: np.ndarray, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words (by number) whose proposed tokens don't spell them, byte for byte: a hash has matched wrongly."""
        size = self.spelled_size[ids]
        begin = np.cumsum(size) - size
        spelt = self.spelling[np.arange(int(size.sum())) + np.repeat(self.spelled_at[ids] - begin, size)]
        wrong = owner[self.closes[ids] != (begin + size == end[owner])]
        if len(spelt) == len(data):
            return np.append(wrong, np.repeat(owner, size)[spelt != data])
        return np.unique(owner)  # no word's tokens can be told from the next one's

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        ids = [self.base[b, False] for b in word[:-1]] + [self.base[word[-1], True]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.merges.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := self.merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := self.merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (r, h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side, one merge of each a round: ids, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[data]
        last = np.cumsum(size) - 1
        ids[last] = self.final[data[last]]
        rank = np.full(len(ids), NEVER)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self._merge_rank(ids[:-1], ids[1:]), NEVER)
        done_owner, done_ids = [], []
        while len(ids):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(rank, begin)
            over = least == NEVER
            if over.any():
                gone = np.repeat(over, count)
                done_owner.append(owner[gone])
                done_ids.append(ids[gone])
                ids, owner, rank = ids[~gone], owner[~gone], rank[~gone]
                least, count = least[~over], count[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            ids[at] = self.made[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at = at - np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                rank[i] = NEVER
                i = i[i + 1 < len(ids)]
                i = i[owner[i] == owner[i + 1]]
                rank[i] = self._merge_rank(ids[i], ids[i + 1])
        owners, out = np.concatenate(done_owner), np.concatenate(done_ids)
        return out[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct non-empty words end to end, and how many each has."""
        spelled = [w.encode() for w in words]
        size = np.array([len(w) for w in spelled], np.int64)
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(spelled), np.uint8)
        owner, ids = self._propose(data, end - size, end)
        fails = np.zeros(len(words), bool)
        fails[self._misspelled(data, owner, ids, end)] = True
        fails[owner[~self.sound[ids]]] = True
        same = np.flatnonzero(owner[1:] == owner[:-1])
        fails[owner[same[~self.compatible(ids[same], ids[same + 1])]]] = True
        keep = ~fails[owner]
        count = np.bincount(owner, minlength=len(words))
        short, long = np.flatnonzero(fails & (size <= SHORT_WORD)), np.flatnonzero(fails & (size > SHORT_WORD))
        merged = [np.array(self.merge(spelled[i]), np.int64) for i in long.tolist()]
        count[long] = [len(x) for x in merged]
        if len(short):
            found, count[short] = self.merge_many([spelled[i] for i in short.tolist()])
        out = np.zeros(int(count.sum()), np.int64)
        out[np.repeat(~fails, count)] = ids[keep]
        if len(short):
            out[np.repeat(fails & (size <= SHORT_WORD), count)] = found
        if len(long):
            out[np.repeat(fails & (size > SHORT_WORD), count)] = np.concatenate(merged)
        return out, count


class TextEncoder:
    """Encodes texts as a tokenizer file says.

    Special strings in a text become their ids, or with ``plain`` are text like any other.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = plain
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)))
        self.speculative = spec["model"]["end_of_word_suffix"] == WORD_END
        if self.speculative:
            self.bpe = SpeculativeBPE(path)
            self.words = Encoder(self.bpe.encode_words, spaced=False)
        else:
            self.words = Encoder(self._library, spaced=True)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

    def strings(self) -> list[str]:
        """The string of each id."""
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def _normal(self, texts: list[str]) -> list[str]:
        if not self.speculative:
            return texts
        return [self.tokenizer.normalizer.normalize_str(t) if not t.isascii() and _COMPOSABLE.search(t) else t.lower() for t in texts]

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, str, int | None]]:
        """Text number, part of the text without special strings, and the id that follows it, if any."""
        for i, t in enumerate(texts):
            begin = 0
            if not self.plain and "<|" in t:
                for m in self.special_pattern.finditer(t):
                    yield i, t[begin : m.start()], self.special[m[0]]
                    begin = m.end()
            while len(t) - begin > PART_CHARS and (m := _SAFE_CUT.search(t, begin + PART_CHARS - 1)):
                yield i, t[begin : m.end()], None
                begin = m.end()
            yield i, t[begin:], None

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's offset among them."""
        found, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)

        def encode_parts(parts: list[tuple[int, str, int | None]]) -> None:
            ids, at = self.words(self._normal([p for _, p, _ in parts]))
            of = np.array([i for i, _, _ in parts], np.int64)
            after = [(at[k + 1], special) for k, (_, _, special) in enumerate(parts) if special is not None]
            if after:
                ids = np.insert(ids, [a for a, _ in after], [s for _, s in after])
            np.add.at(sizes, of, np.diff(at) + np.array([s is not None for _, _, s in parts]))
            found.append(ids)

        held: list[tuple[int, str, int | None]] = []
        chars = 0
        for part in self._parts(texts):
            if held and chars + len(part[1]) > 2 * PART_CHARS:
                encode_parts(held)
                held, chars = [], 0
            held.append(part)
            chars += len(part[1])
        if held:
            encode_parts(held)
        return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)])


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add each text's token ids; a null or empty text has none.

    ``tokenizer_path`` is a tokenizer file that every executor can open. Repeated rows are
    encoded one by one, an empty table gives an empty one. Long texts are encoded part by
    part, cut before single spaces; one without such a space is encoded whole, at about
    fifty bytes a character.
    """

    def make():
        encoder = TextEncoder(tokenizer_path)

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            found, offsets = encoder([t or "" for t in part.column(text).to_pylist()])
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.astype(np.int32)))]

        return step

    return tx.append_columns(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, text)


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids, special tokens included; null ids decode to an empty text."""
    names = rows.columns

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        plain = tokenizer.decoder is None
        strings = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        for batch in batches:
            for begin in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(begin, DECODE_ROWS)
                column = part.column(ids)
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                ends, flat = np.cumsum(size).tolist(), column.flatten().to_numpy()
                lists = (flat[e - n : e].tolist() for e, n in zip(ends, size.tolist(), strict=True))
                texts = [" ".join(map(strings.__getitem__, x)) for x in lists] if plain else [tokenizer.decode(x, skip_special_tokens=False) for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, text])
        del tokenizer, strings
        tx.give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
