"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the bytes before a blank hits 1 in CUT, so equal
passages give equal chunks wherever they stand. A chunk that several documents hold is encoded
once, on the document of least id that has it; the rest of each text is encoded in place, and the
parts are joined.

A join is trusted if both sides agree that tokens can't cross it: a blank on the left and an
ordinary visible character on the right. At any other join a window of stretches over it is encoded anew and widened until
its ends agree with what stands on both sides and a wider one changes nothing; its ids replace those about the join.

Files that lower-case and drop blanks, like the registered one, have trusted joins, and within a stretch between blanks
encoding doesn't depend on what lies outside, so words are remembered by each worker as well, in a
memory that is emptied by half when it is full. With other files all joins are repaired, and no words are remembered.

Ids and texts are those of the tokenizers library. Null texts count as empty: no tokens, and the digests of the empty text.
Rows that repeat are one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import by_size
from claimweave.session import small_batches

CUT, WINDOW, MEMORY, LEAST = 128, 12, 180_000, 48
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 32]] = True
#: What may follow a trusted join: any byte of ASCII that is visible, or a lead byte of Latin letters.
FOLLOW = np.zeros(256, bool)
FOLLOW[33:127] = True
FOLLOW[0xC3:0xCA] = True


def cut_all(raws: list[bytes]) -> list[list[int]]:
    """For each text, where its chunks start, after 0: behind blanks where the hash of the bytes before hits."""
    out: list[list[int]] = [[] for _ in raws]
    b = np.frombuffer(b"\n".join(raws), np.uint8)
    if len(b) <= WINDOW:
        return out
    at = np.flatnonzero(BLANKS[b[WINDOW - 1 : -1]] & ~BLANKS[b[WINDOW:]]) + WINDOW
    h = np.zeros(len(at), np.uint64)
    for j in range(1, WINDOW + 1):
        h = (h ^ b[at - j]) * np.uint64(0x100000001B3)
    h ^= h >> np.uint64(29)
    at = at[(h >> np.uint64(8)) % np.uint64(CUT) == 0]
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    of = np.searchsorted(starts, at, side="right") - 1
    inside = at - starts[of] >= WINDOW
    for i, x in zip(of[inside].tolist(), (at - starts[of])[inside].tolist()):
        out[i].append(x)
    return out


def chunk_all(texts: list[str | None]) -> list[list[bytes]]:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for raw, at in zip(raws, cut_all(raws)):
        ends = [0, *at, len(raw)]
        out.append([raw[i:j] for i, j in zip(ends, ends[1:]) if j > i])
    return out


def chunk_key(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


class Coder:
    """A tokenizer with its memory of words: the ids and the tokens of a word, each as text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = {i: t for t, i in vocabulary.items()}
        self.numbers = {i: str(i) for i in self.names}
        self.kind = "<u2" if max(self.names) < 65536 else "<u4"
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = '"Lowercase"' in json.dumps(rules["normalizer"]) and '"Removed"' in json.dumps(rules["pre_tokenizer"])
        self.plain = self.tokenizer.decoder is None  # then decode() joins tokens by a blank
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.ids))
        if len(self.ids) + len(new) > MEMORY:
            for w in list(islice(self.ids, len(self.ids) // 2)):
                del self.ids[w], self.tokens[w]
            new = list(words.difference(self.ids))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = e.ids
                self.ids[w] = " ".join([self.numbers[t] for t in ids])
                self.tokens[w] = " ".join([self.names[t] for t in ids])

    def encode(self, pieces: list[list[str]]) -> Iterator[tuple[str, str]]:
        """For each list of words: their ids, and their tokens, as text."""
        if not self.by_words:
            for words in pieces:
                yield self.text_of(self.direct("".join(words)))
            return
        i = 0
        while i < len(pieces):
            need: set[str] = set()
            j = i
            while j < len(pieces) and (j == i or len(need) < MEMORY // 4):
                need.update(pieces[j])
                j += 1
            self.learn(need)
            empty = {w for w in need if not self.ids[w]}
            for words in pieces[i:j]:
                if empty:
                    words = [w for w in words if w not in empty]
                yield " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.tokens.__getitem__, words))
            i = j

    def words(self, text: str) -> list[str]:
        return words_of(text) if self.by_words else [text]

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def text_of(self, ids: list[int]) -> tuple[str, str]:
        return " ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def trusted(self, raw: bytes, at: int) -> bool:
        return self.by_words and bool(BLANKS[raw[at - 1]] and FOLLOW[raw[at]])

    def repaired(self, raw: bytes, starts: list[int], parts: list[list[int]]) -> list[int]:
        """The ids of a text from those of its parts, of which each begins at one of ``starts``."""
        out = parts[0]
        for at, end, part in zip(starts[1:], [*starts[2:], len(raw)], parts[1:]):
            out = out + part if self.trusted(raw, at) else self.joined(raw, at, end, out, part)
        return out

    def joined(self, raw: bytes, at: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of ``raw`` up to ``end`` from those up to and behind ``at``."""
        wide, before = 1, None
        while True:
            i, j = stretches_before(raw, at, wide), stretches_behind(raw, at, end, wide)
            head, tail = raw[i:at].decode("utf-8", "surrogatepass"), raw[at:j].decode("utf-8", "surrogatepass")
            both = self.direct(head + tail)
            # How many ids at the window's ends are its own fault, and not found outside; one more must agree.
            skip = more = 0
            start, rest, agree = [], [], True
            if i:
                own = self.direct(head)
                same = alike(own[::-1], left[::-1])
                skip = len(own) - same
                start, agree = left[: len(left) - same], alike(own, both) > skip
            if j < end:
                own = self.direct(tail)
                same = alike(own, right)
                more = len(own) - same
                rest, agree = right[same:], agree and alike(own[::-1], both[::-1]) > more
            if agree and skip + more <= len(both):
                now = start + both[skip : len(both) - more] + rest
                if now == before or (not i and j >= end):
                    return now
                before = now
            wide *= 2

    def pack(self, ids: str) -> bytes:
        return np.array(ids.split(), dtype=self.kind).tobytes()

    def unpack(self, packed: bytes) -> tuple[str, str]:
        return self.text_of(np.frombuffer(packed, self.kind).tolist())


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def alike(a: list[int], b: list[int]) -> int:
    """How many ids at the start are the same."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def stretches_before(raw: bytes, at: int, n: int) -> int:
    """Where the nth stretch between blanks before a place starts."""
    for _ in range(n):
        at = len(raw[:at].rstrip(b" \t\n"))
        at = 1 + max(raw.rfind(b" ", 0, at), raw.rfind(b"\t", 0, at), raw.rfind(b"\n", 0, at))
        if not at:
            break
    return at


def stretches_behind(raw: bytes, at: int, end: int, n: int) -> int:
    """Where the nth stretch behind a place ends, or ``end``."""
    ends = [x.end() for x in islice(STRETCH.finditer(raw, at, end), n)]
    return ends[-1] if len(ends) == n else end


STRETCH = re.compile(rb"[^ \t\n]+")
BREAK = re.compile(r"[ \t\n]+")
#: A comma or full stop alone behind a letter is a token of its own, so it is remembered apart from the word.
STOP = re.compile(r"(?<=[^\W\d_])(?=[,.](?:\s|$))")
#: Blanks to str.split() that the tokenizer takes as characters.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def words_of(text: str) -> list[str]:
    """Stretches that encode the same alone as in the text.

    Of texts in Latin-1 these are the words, lower-cased where no special token can be meant, and
    the stops behind them. Of others, stretches between ASCII blanks; one that starts with a
    combining mark or other character that could join across the blank stays with what comes before."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        if not any(x in text for x in SEPARATORS):
            if "<|" in text:
                return text.split()
            return STOP.sub(" ", text.lower()).split()
    out: list[str] = []
    for p in BREAK.split(text):
        if p:
            if out and ord(p[0]) >= 0x300 and not p[0].isalnum():
                out[-1] += " " + p
            else:
                out.append(p)
    return out


def chunk_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of the chunks of at least LEAST bytes, each once a document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in by_size(whole, "text", 8_000_000)):
            ids, keys = [], []
            for i, parts in zip(batch["doc_id"], chunk_all(batch["text"].tolist())):
                own = {chunk_key(c) for c in parts if len(c) >= LEAST}
                ids += [i] * len(own)
                keys += own
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "key": keys})

    return docs.mapInPandas(run, "doc_id long, key binary")


def shared_chunks(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, shared): for each document its chunks that others have too, with their ids.

    Chunks are counted by key, summed before the shuffle. Each shared chunk is encoded on one
    document; the join that brings its ids to all who have it is on the key, and may split."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    refs = chunk_refs(docs)
    owners = refs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where("n > 1").select("key", "owner")
    wanted = owners.groupBy("owner").agg(F.collect_list("key").alias("keys")).withColumnRenamed("owner", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for batch in (part for whole in batches for part in by_size(whole, "text", 8_000_000)):
            found: dict[bytes, bytes] = {}
            for parts, keys in zip(chunk_all(batch["text"].tolist()), batch["keys"]):
                want = set(keys)
                found |= {k: c for c in parts if len(c) >= LEAST and (k := chunk_key(c)) in want}
            coded = own.encode([own.words(c.decode("utf-8", "surrogatepass")) for c in found.values()])
            yield pd.DataFrame({"key": list(found), "ids": [own.pack(i) for i, _ in coded]})

    coded = docs.join(wanted, "doc_id").select("text", "keys").mapInPandas(run, "key binary, ids binary")
    coded = coded.dropDuplicates(["key"])  # documents that repeat an id
    return refs.join(coded, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "ids")).alias("shared"))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """The digests of RESULT for every row; with ``keep_ids`` also the ids, as text."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = RESULT + (", ids string" if keep_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for batch in (part for whole in batches for part in by_size(whole, "text", 8_000_000)):
            texts = batch["text"].tolist()
            having = [i for i, x in enumerate(batch["shared"]) if x is not None and len(x)]
            parts_of = dict(zip(having, chunk_all([texts[i] for i in having])))
            plans, fresh = [], []
            for i, (text, shared) in enumerate(zip(texts, batch["shared"])):
                if i not in parts_of:
                    plans.append([(0, len(fresh))])
                    fresh.append(own.words(text))
                    continue
                have = {bytes(x["key"]): bytes(x["ids"]) for x in shared}
                plan, rest, at = [], [], 0
                for c in [*parts_of[i], None]:
                    ids = have.get(chunk_key(c)) if c is not None and len(c) >= LEAST else None
                    if (ids is not None or c is None) and rest:
                        between = b"".join(rest)
                        plan.append((at - len(between), len(fresh)))
                        fresh.append(own.words(between.decode("utf-8", "surrogatepass")))
                        rest = []
                    if ids is not None:
                        plan.append((at, ids))
                    elif c is not None:
                        rest.append(c)
                    at += len(c or b"")
                plans.append(plan)
            coded = own.encode(fresh)
            out = []
            for text, plan in zip(texts, plans):
                both = [next(coded) if isinstance(part, int) else own.unpack(part) for _, part in plan]
                starts = [at for at, _ in plan]
                raw = text.encode("utf-8", "surrogatepass") if len(plan) > 1 else b""
                if all(own.trusted(raw, at) for at in starts[1:]):
                    joined, decoded = " ".join([x for x, _ in both if x]), " ".join([x for _, x in both if x])
                else:
                    joined, decoded = own.text_of(own.repaired(raw, starts, [[int(i) for i in x.split()] for x, _ in both]))
                if not own.plain:
                    decoded = own.tokenizer.decode([int(i) for i in joined.split()], skip_special_tokens=False)
                row = (joined.count(" ") + 1 if joined else 0, sha256(joined.encode()).hexdigest(), sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, joined) if keep_ids else row)
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    named = rows.where("doc_id IS NOT NULL")  # both joins of the texts then use one shuffle of them
    joined = named.join(shared_chunks(named, path), "doc_id", "left").select("doc_id", "text", "shared")
    nameless = rows.where("doc_id IS NULL").withColumn("shared", F.lit(None).cast(joined.schema["shared"].dataType))
    return joined.unionByName(nameless).mapInPandas(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_all(docs: DataFrame) -> DataFrame:
    return encode_documents(docs, default_path())
