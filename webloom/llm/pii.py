"""Operator 10, PII: keyed surrogates of the same type, gender, script and format.

Every detected value is replaced by a surrogate derived from a secret key and the value, so that a value
reads the same wherever it occurs, without a table of values. Digits of phones, cards and the like are
permuted by a keyed Feistel network over numbers of the same length: it maps one to one, so different
values of one format cannot meet. Words (mail names, given names) and tokens are drawn from keyed bytes.
A job over the distinct values then looks for surrogates that two values share, or that occur as a value
themselves; all but the smallest such value draw again until none is left. Texts are rewritten with the
drawn numbers of redrawn values, whose table is joined by document.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import bytes_of, keep, texts_of, work_folder


def _letters(*categories: str) -> str:
    """Inside of a character class with all signs of these Unicode categories."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in categories]
    cuts = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1]
    return "".join(f"{chr(codes[i])}-{chr(codes[j - 1])}" for i, j in zip([0, *cuts], [*cuts, len(codes)]))


#: Letters that begin a name (capitals, and letters of scripts without cases), letters and marks inside, letters of addresses.
UPPER, INNER, MAIL = _letters("Lu", "Lt", "Lo"), _letters("Lu", "Lt", "Lo", "Ll", "Lm", "Mn", "Mc"), "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯḀ-ỿ"
WORD = f"(?:[{UPPER}][{INNER}]*(?:-[{INNER}]+|['’][{UPPER}][{INNER}]*)*)"
PARTICLES = "(?:(?:van|von|vom|zu|zur|de|der|den|del|della|di|da|do|dos|du|la|le|al|bin|ibn|af|av|y|e) )*"
TITLES = ("Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor ", "Señora ")
#: Kinds in order of precedence: of overlapping finds the earlier start, then the earlier kind, wins.
PATTERNS = {
    "email": rf"[{MAIL}0-9._%+-]+@(?:[{MAIL}0-9-]+\.)+[{MAIL}]{{2,}}",
    "secret": r"(?<=[=:] \")[0-9A-Fa-f]{32,}(?=\")|(?<=[=:]\")[0-9A-Fa-f]{32,}(?=\")|(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)(?=(?:[ .-]?\d){6})[ .-]?\d{2,}(?:[ .-]\d{2,})*(?!\w)|(?<![\w+])\+(?=\d(?:[ .-]?\d){4})\d+(?:[ .-]\d+)*(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.-])\d{3}-\d{4}(?![\w-])",
    "name": f"(?:{'|'.join(f'(?<={re.escape(t)})' for t in TITLES)})(?:[{UPPER}]\\. )*{PARTICLES}{WORD}(?: (?:[{UPPER}]\\. )*{PARTICLES}{WORD})*",
}
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these signs holds none of the kinds, so it need not be searched. Each pattern implies one: mail
#: an @, secrets 32 hexadecimal digits, names a title, addresses a digit and a dot, + a digit, all other numbers two digits in a row.
HINT = re.compile(r"@|\d\d|\d\.\d|\+\d|[0-9a-fA-F]{32}|(?:" + "|".join(map(re.escape, TITLES)) + ")")
MASCULINE = ("Mr ", "Mr. ", "Herr ", "Monsieur ", "Señor ")
VOWELS, CONSONANTS = "aeiou", "bdfgklmnprst"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a whole text, in order, without overlaps.

    A name's kind tells the gender of its title: ``name_m`` or ``name_f``. A card must pass the Luhn test
    to count as a card; other sixteen digits are ``digits``.
    """
    if not HINT.search(text):
        return []
    found = []
    for m in FIND.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "name":
            kind = "name_m" if text[: m.start()].endswith(MASCULINE) else "name_f"
        elif kind == "card" and not _luhn(re.sub(r"\D", "", value)):
            kind = "digits"
        found.append((m.start(), m.end(), kind, value))
    return found


def _luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    odd = [int(d) for d in digits[-1::-2]]
    return sum(odd) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])


#: Lower-case letters in use of scripts whose Unicode range also holds historic ones.
ALPHABETS = {"CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}


def _script(letter: str) -> str:
    return unicodedata.name(letter, "LATIN").split(" ")[0].split("-")[0]


def _pool(script: str) -> str:
    """Letters of a script, in lower case where it has cases."""
    return ALPHABETS.get(script) or "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and c == c.lower() and _script(c) == script)


class Surrogates:
    """Keyed surrogates; ``draw`` 0 is the first choice, others follow collisions."""

    def __init__(self, key: bytes):
        self.key = key
        self.pools: dict[str, str] = {}

    def _letters(self, script: str) -> str:
        if script not in self.pools:
            self.pools[script] = _pool(script)
        return self.pools[script]

    def _stream(self, *parts: object) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256), "big")

    def permute(self, digits: str, tag: str) -> str:
        """One-to-one keyed map of the decimal strings of this length."""
        n = len(digits)
        if n < 2:
            return str((int(digits) + self._stream(tag, n)) % 10) if digits else digits
        a, b = digits[: n // 2], digits[n // 2 :]
        for turn in range(8):  # halves change places; each keeps its length
            if turn % 2:
                a = str((int(a) + self._stream(tag, n, turn, b)) % 10 ** len(a)).zfill(len(a))
            else:
                b = str((int(b) + self._stream(tag, n, turn, a)) % 10 ** len(b)).zfill(len(b))
        return a + b

    def _digits(self, value: str, tag: str, keep_first: int = 0) -> str:
        """All digits but the first few permuted, other signs in place."""
        old = re.sub(r"\D", "", value)
        new = iter(old[:keep_first] + self.permute(old[keep_first:], f"{tag} {re.sub(chr(92) + 'd', '0', value)} {old[:keep_first]}"))
        return re.sub(r"\d", lambda _: next(new), value)

    def _word(self, like: str, seed: int, end: str = "", least: int = 6) -> str:
        """Pronounceable letters, in the case of ``like``; letters beyond ASCII call for one of their script."""
        script = next((_script(c) for c in like if c.isalpha()), "LATIN")
        if script != "LATIN" and (pool := self._letters(script)):
            cased = like.lower() != like.upper()
            size, out = max(len(like), least if cased else 3), ""
            for _ in range(size):
                seed, r = divmod(seed, len(pool))
                out += pool[r]
            return (out.upper() if like.isupper() else out.title() if like[:1].isupper() else out) if cased else out
        size = max(len(like), least) - len(end)
        out = []
        for i in range(size):
            pool = CONSONANTS if i % 2 == 0 else VOWELS
            seed, r = divmod(seed, len(pool))
            out.append(pool[r])
        word = "".join(out) + end
        odd = [c for c in like.lower() if ord(c) > 127 and c.isalpha()]
        if odd:
            word = word[: len(word) // 2] + odd[0] + word[len(word) // 2 + 1 :]
        if like.isupper():
            return word.upper()
        return word[:1].upper() + word[1:] if like[:1].isupper() else word

    def _parts(self, word: str, tag: str, draw: int, end: str, least: int) -> str:
        parts = re.split("([-'’.])", word)
        return "".join(self._word(p, self._stream(tag, p, draw), end, least) if i % 2 == 0 and p else p for i, p in enumerate(parts))

    def of(self, kind: str, value: str, draw: int = 0) -> str:
        if kind == "email":
            name, _, host = value.rpartition("@")
            seed = self._stream(kind, value.lower(), draw)
            parts = re.split(r"([._%+-]+)", name)
            for i, p in enumerate(parts):
                if p.isdigit():
                    seed, r = divmod(seed, 10 ** len(p))
                    parts[i] = str(r).zfill(len(p))
                elif i % 2 == 0 and p:
                    parts[i] = self._word(p, seed, least=10)
                    seed >>= 40
            labels = host.split(".")
            labels[-2] = f"{self._word(labels[-2], seed)}{self._stream('host', value.lower(), draw) % 1000:03d}"
            return "".join(parts) + "@" + ".".join(labels[:-2] + [labels[-2], labels[-1]])
        if kind in ("name_m", "name_f"):
            # Words and the parts of words with hyphens, apostrophes and dots one by one; particles are drawn, too.
            words = value.split(" ")
            end = "o" if kind == "name_m" else "a"
            out = [self._parts(words[0], kind, draw, end, 6)]
            return " ".join(out + [self._parts(w, "family", draw, "n", 8) for w in words[1:]])
        if kind == "secret":
            pool = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
            out, turn = "", 0
            while len(out) < len(value):
                out += f"{self._stream(kind, value, draw, turn):064x}"
                turn += 1
            return "".join(pool[int(c, 16)] for c in out[: len(value)])
        tag = f"{kind} {draw}" if draw else kind
        if kind == "ip":
            n = int.from_bytes(bytes(map(int, value.split("."))), "big")
            low, high = n & 0xFFFF, n >> 16
            for turn in range(6):
                low, high = high ^ (self._stream(tag, turn, low) & 0xFFFF), low
            return ".".join(map(str, ((high << 16) | low).to_bytes(4, "big")))
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            body = digits[:1] + self.permute(digits[1:-1], f"{tag} {digits[:1]}")
            check = str(-_luhn_sum(body + "0") % 10)
            new = iter(body + check)
            return re.sub(r"\d", lambda _: next(new), value)
        if kind == "iban":
            return value[:2] + self._digits(value[2:], tag)
        if kind == "phone":  # the country code stays
            code = re.match(r"\+(\d{1,3})(?=\D)", value)
            return self._digits(value, tag, len(code.group(1)) if code else 0)
        return self._digits(value, tag)


def _rows(batch: pa.RecordBatch, column: int):
    for a, texts in texts_of(batch.column(column)):
        yield from enumerate((t.decode("utf-8", "replace") for t in texts), a)


def entities(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, kind, value): character spans of all entities of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), []
            for i, t in _rows(batch, 1):
                out += [(keys[i].as_py(), *f) for f in find(t)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["doc_id", "start", "end", "kind", "value"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), bytes_of(F.col(f"`{text}`")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, start int, end int, kind string, value string")


def _drawn(values: DataFrame, secret: bytes) -> DataFrame:
    """(kind, value, draw) with the surrogate of that draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(secret)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([make.of(*r) for r in rows], pa.string())], ["kind", "value", "draw", "surrogate"])

    return values.select("kind", "value", "draw").mapInArrow(run, "kind string, value string, draw int, surrogate string")


def assign(values: DataFrame, secret: bytes, folder: str) -> DataFrame:
    """(kind, value, draw, surrogate) of distinct values: no two share a surrogate, none is a value of the corpus.

    Each turn finds the surrogates of several values, of which the smallest keeps it, and those that
    occur as a value; the others draw again. Turns end when nothing is left to draw; a format that is
    exhausted raises an error.
    """
    now = keep(_drawn(values.withColumn("draw", F.lit(0)), secret), folder, "drawn-0")
    turn = 0
    while True:
        owners = now.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("own"), F.count("*").alias("c"))
        taken = values.select(F.col("value").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
        clash = owners.join(taken, "surrogate", "left").filter("c > 1 OR taken")
        bad = now.join(clash.select("surrogate", "own", "taken"), "surrogate").filter(
            F.col("taken").isNotNull() | (F.struct("kind", "value") != F.col("own"))
        )
        again = keep(_drawn(bad.withColumn("draw", F.col("draw") + 1), secret), folder, f"again-{turn}")
        if again.isEmpty():
            return now
        turn += 1
        if turn > 64:
            raise ValueError("no free surrogates: a format has nearly as many values as it can have")
        rest = now.join(again.select("kind", "value"), ["kind", "value"], "left_anti")
        now = keep(rest.unionByName(again), folder, f"drawn-{turn}")


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id", found: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``found``, a column of that name lists (kind, surrogate) in order.

    All rows and columns stay, null texts stay null, rows of equal ids are rewritten each. Values are
    told apart by kind and spelling. Only values that had to draw again are joined to the texts, by document.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "pii")
    seen = keep(entities(docs, text, key).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n")), folder, "entities")
    values = keep(seen.select("kind", "value").distinct(), folder, "values")
    redrawn = assign(values, secret, folder).filter("draw > 0").select("kind", "value", "draw")
    per_doc = seen.join(redrawn, ["kind", "value"]).groupBy("doc_id").agg(
        F.to_json(F.collect_list(F.array("kind", "value", F.col("draw").cast("string")))).alias("__draws")
    )
    per_doc = keep(per_doc, folder, "draws")
    names = [c for c in docs.columns if c != found]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    joined = docs.join(per_doc.withColumnRenamed("doc_id", "__k"), F.col(f"`{key}`") == F.col("__k"), "left").drop("__k")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        make = Surrogates(secret)
        for batch in batches:
            for a, rows in texts_of(batch.column(0)):
                part = batch.slice(a, len(rows))
                texts, lists = [], []
                for t, null, draws in zip(rows, part.column(1).to_pylist(), part.column(2).to_pylist()):
                    t = t.decode("utf-8", "replace")
                    over = {(k, v): int(d) for k, v, d in json.loads(draws)} if draws else {}
                    out, last, made = [], 0, []
                    for s, e, kind, value in find(t):
                        new = make.of(kind, value, over.get((kind, value), 0))
                        out += [t[last:s], new]
                        last = e
                        made.append({"kind": kind, "surrogate": new})
                    texts.append(None if null else "".join(out) + t[last:])
                    lists.append(made)
                columns = list(part.columns[3:])
                columns[at] = pa.array(texts, pa.string())
                more = [pa.array(lists, pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string())])))] if found else []
                yield pa.RecordBatch.from_arrays(columns + more, names + ([found] if found else []))

    schema = docs.schema
    if found:
        schema = schema.add(found, T.ArrayType(T.StructType().add("kind", "string").add("surrogate", "string")))
    source = joined.select(bytes_of(F.col(f"`{text}`")).alias("__t"), F.col(f"`{text}`").isNull().alias("__n"), "__draws", *[F.col(f"`{c}`") for c in names])
    return source.mapInArrow(run, schema)
