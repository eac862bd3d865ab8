"""Operator 1: exact BPE encoding in linear time, and decoding through an offset table.

Encoding. Each pre-token is a string of symbols (its bytes; the last byte in its word-end form). An Aho-Corasick
automaton finds the longest vocabulary token at every position. The encoder walks left to right taking the
longest token that is *compatible* with its predecessor; a pair is compatible when byte-pair merging of the
concatenation would leave exactly those two tokens, which is decided from the merge table (the two tokens are
taken apart in reverse merge order and no cheaper merge may span the border). Where nothing fits, the last token
is shortened to its next prefix token and the dead position is marked, so every position fails at most once and
the walk is linear in the length of the pre-token. The result equals the merges done in rank order.

Decoding. All token strings lie in one buffer; ``offsets[i]:offsets[i + 1]`` is token ``i``. Ids are turned into
bytes by one gather over that table.

Defined results: null text counts as empty (no ids, empty decoded text); texts may be of any length; repeated rows
get equal results; an empty table gives an empty table; an input column with an output's name is replaced; all
other columns are kept as they are.
"""


import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm import common

common.ship(__name__)

#: Words whose ids a Python worker keeps, and pairs of tokens it has judged; emptied when full.
WORD_CACHE, PAIR_CACHE = 120_000, 50_000
#: Characters of the texts whose distinct chunks are encoded together.
GROUP_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 256
    for b in plain:
        table[b] = chr(b)
    for b in range(256):
        if not table[b]:
            table[b], spare = chr(spare), spare + 1
    return table


class Offsets:
    """The decoding side of a tokenizer file: all token strings in one buffer, each followed by a space."""

    def __init__(self, raw: bytes):
        import numpy as np

        spec = json.loads(raw)
        named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
        self.size = 1 + max(i for _, i in named)
        strings = [b""] * self.size
        for t, i in named:
            strings[i] = t.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def decode(self, ids) -> str:
        """Token strings joined by one space; ids outside the vocabulary are dropped."""
        import numpy as np

        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < self.size)]
        out = []
        for at in range(0, len(ids), 100_000):
            part = ids[at : at + 100_000]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.buffer[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1].decode()


class Numbers(dict):
    """Each key's place in the order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class WordIds:
    """Ids of words seen before, all in one array; emptied when it holds ``WORD_CACHE`` words."""

    def __init__(self, make):
        import array

        self.make, self.known, self.ids = make, {}, array.array("i")

    def __getitem__(self, word: str):
        place = self.known.get(word)
        if place is not None:
            return self.ids[place >> 8 : (place >> 8) + (place & 255)]
        found = self.make(word)
        if len(word) <= 64 and len(found) < 256:
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
                del self.ids[:]
            self.known[word] = len(self.ids) << 8 | len(found)
            self.ids.extend(found)
        return found


class Tables:
    """The encoding side: vocabulary, merge tables and automaton (bounded by the vocabulary's size)."""

    def __init__(self, raw: bytes):
        import ahocorasick
        import regex

        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.odd_space = regex.compile("[\x1c-\x1f]")  # white space to str.split, but not to the pattern
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*vocab.values(), *self.specials.values()])

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = [byte_of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        self.id_of = {symbols(t): i for t, i in vocab.items()}
        # by id; a single symbol is taken apart into itself
        self.length, self.left, self.right = [0] * self.size, [-1] * self.size, [-1] * self.size
        for s, i in self.id_of.items():
            self.length[i] = len(s)
            if len(s) == 1:
                self.left[i] = self.right[i] = i
        self.merged, rank = {}, {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole, a, b = vocab[left + right], vocab[left], vocab[right]
            if whole in rank:
                raise ValueError("a token that two merges make has no single place in the merge order")
            self.merged[a << 32 | b], self.left[whole], self.right[whole], rank[whole] = whole, a, b, r
        # the walk compares tokens by merge order, which must be the order of their ids
        order = sorted(rank, key=rank.get)
        if order != sorted(order) or (order and order[0] <= max(i for i in self.id_of.values() if i not in rank)):
            raise ValueError("ids do not follow the merge order")
        shorter: list[int | None] = [None] * self.size
        for s, i in self.id_of.items():
            shorter[i] = next((self.id_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.id_of), None)
        self.shorter = shorter
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.automaton.add_word(s, (i, len(s) - 1))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

        self.words_seen = WordIds(self.encode_word)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' symbols in rank order leaves exactly these two tokens."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIR_CACHE:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = self.size
        while True:
            across = self.merged.get(left << 32 | right)
            if across is not None and across < limit:
                return False
            # undo the later of the two merges; equal ids are undone on the right, as merges run from the left
            if left > right:
                if self.right[left] != left:
                    limit, left = left, self.right[left]
                    continue
                if self.left[right] == right:
                    return True
                limit, right = right + 1, self.left[right]
            else:
                if self.left[right] != right:
                    limit, right = right + 1, self.left[right]
                    continue
                if self.right[left] == left:
                    return True
                limit, left = left, self.right[left]

    def encode_symbols(self, s: str) -> list[int]:
        whole = self.id_of.get(s)
        n = len(s)
        if whole is not None and n <= 2:
            return [whole]
        longest: list[int | None] = [None] * n
        for end, (token, before) in self.automaton.iter(s):
            longest[end - before] = token  # ends rise, so the last one at a start is the longest
        open_ = bytearray(b"\x01") * (n + 1)
        if whole is not None and longest[0] == whole:
            return [whole]  # nothing stands before it, so nothing can forbid it
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            before = out[-1] if out else None
            while True:
                end = at + length[token]
                if open_[end] and (before is None or compatible(before, token)):
                    out.append(token)
                    at, token = end, (longest[end] if end < n else None)
                    break
                token = shorter[token]
                if token is None:
                    if before is None:
                        raise ValueError("no encoding")
                    open_[at] = 0
                    out.pop()
                    at, token = at - length[before], before
                    break
        return out

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        if self.suffix:
            return self.encode_symbols(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
        return self.encode_symbols(raw.decode("latin-1"))

    def chunks(self, text: str) -> list:
        """A text's special tokens (as tuples of their id) and the chunks between white space, in order.

        No pre-token holds white space, so chunks can be encoded apart.
        """
        parts = self.special_split.split(text) if self.special_split else (text,)
        out: list = []
        for part in parts:
            if part in self.specials:
                out.append((self.specials[part],))
            elif part:
                part = self.normal(part)
                out.extend(self.words.findall(part) if self.odd_space.search(part) else part.split())
        return out

    def encode_all(self, texts: list[str]):
        """Ids of all texts in one array, and where each text's ids end: each distinct chunk is encoded once and its ids
        gathered for every place where it stands."""
        import array

        import numpy as np

        numbers, places, counts = Numbers(), array.array("i"), []
        for text in texts:
            found = self.chunks(text)
            places.extend(map(numbers.__getitem__, found))
            counts.append(len(found))
        flat, sizes, seen = array.array("i"), [], self.words_seen
        for chunk in numbers:
            before = len(flat)
            if isinstance(chunk, tuple):
                flat.append(chunk[0])
            else:
                for w in self.words.findall(chunk):
                    flat.extend(seen[w])
            sizes.append(len(flat) - before)
        if not flat:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        at, size = np.frombuffer(places, np.int32), np.array(sizes, np.int64)
        starts, own = (np.cumsum(size) - size)[at], size[at]
        ends = np.cumsum(own)
        ids = np.frombuffer(flat, np.int32)[np.repeat(starts - (ends - own), own) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def normal(self, text: str) -> str:
        """NFC, runs of white space as one space, lower case letter by letter (no final-sigma rule)."""
        import unicodedata

        if text.isascii():
            return text.lower()  # the pre-token pattern drops white space of any length
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()


def _tables(spark: SparkSession, path: str, kind: type):
    """A function that gives tables of a kind on an executor; the file's bytes go there once, by broadcast."""
    with open(path, "rb") as f:
        raw = f.read()
    sent, key = spark.sparkContext.broadcast(raw), f"bpe:{kind.__name__}:{hashlib.sha256(raw).hexdigest()}"
    return lambda: common.per_process(key, lambda: kind(sent.value))


def _with_columns(df: DataFrame, outs: dict[str, str], source: str, source_kind: str, make) -> DataFrame:
    """``df`` with the columns ``outs`` (name: type), replaced if they are there; ``make`` turns an array of ``source`` into
    (rows, arrays of them) in parts, so that a task holds and sends no more than a part's results."""
    kept = [c for c in df.columns if c not in outs]
    rows = df.select(*kept, F.col(source).cast(source_kind).alias("__source"))
    added = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in outs.items()]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__source"], *added])
    names = [*kept, *outs]

    def parts(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for n, values in make(batch.column("__source")):
                columns = [batch.column(c).slice(at, n) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *values], names)
                at += n

    found = rows.mapInArrow(common.tidy(parts), schema)
    return found.select(*df.columns, *[c for c in outs if c not in df.columns])


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``out``: the ids of each text (array<int>, never null); and ``decoded``, if named: the text decoded from them,
    as ``decode`` gives it, without the ids leaving the worker in between."""
    tables, offsets = _tables(df.sparkSession, path, Tables), _tables(df.sparkSession, path, Offsets)

    def ids(texts):
        import numpy as np
        import pyarrow as pa

        t, back = tables(), offsets() if decoded else None
        group, chars = [], 0
        for k, x in enumerate(texts):
            group.append(x.as_py() or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS or k + 1 == len(texts):
                found, ends = t.encode_all(group)
                bounds = np.concatenate([[0], ends])
                columns = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))]
                if decoded:
                    columns.append(pa.array([back.decode(found[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield len(group), columns
                group, chars = [], 0

    return _with_columns(df, {out: "array<int>"} | ({decoded: "string"} if decoded else {}), text_col, "string", ids)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the decoded text of each array of ids (null ids: empty text)."""
    tables = _tables(df.sparkSession, path, Offsets)

    def text(ids):
        import pyarrow as pa

        t = tables()
        for at in range(0, len(ids), 1000):
            part = ids.slice(at, 1000)
            yield len(part), [pa.array([t.decode(x.values.drop_null().to_numpy()) if x.is_valid else "" for x in part], pa.string())]

    return _with_columns(df, {out: "string"}, ids_col, "array<int>", text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every document's ids and decoded text."""
    path = default_path()
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    both = encode(docs, path, decoded="decoded").drop("text")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
