"""Surrogates for personal data and secrets.

Every entity (type and canonical form) of the corpus gets one surrogate, drawn from a keyed stream, of the same
type, script, gender and format; names and mail domains keep their script, not their length. The dictionary of entities is a distributed table: draws that equal
another entity's surrogate or any real entity are drawn again until none do, so distinct entities
stay distinct and all mentions of one get the same surrogate; names share one space, and so do numbers. Names are mapped word
by word, so that a full name and a part of it agree; a word's gender is that of most of its titles in the corpus.
A format that runs out of forms is widened, by a letter or digit every eight rounds.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import string
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, materialize, text_hash, unused

_WORD = r"[^\W\d_][^\W\d_'’\-]*"
_MALE = ("mr", "sir", "herr", "monsieur", "señor", "sr", "don", "г-н", "господин", "κύριος")
_FEMALE = ("mrs", "ms", "miss", "madam", "lady", "frau", "madame", "mme", "mlle", "señora", "señorita", "sra", "srta", "doña", "г-жа", "госпожа", "κυρία")
_OTHER = ("dr", "prof")
_TITLE = "(?:" + "|".join(x for t in sorted((*_MALE, *_FEMALE, *_OTHER), key=len, reverse=True) for x in (t[0].upper() + t[1:], t.upper())) + r")(?!\w)"
_TITLES = frozenset((*_MALE, *_FEMALE, *_OTHER))
#: Words of a name that stay as they are.
_PARTICLES = frozenset("da de del della den der di do dos du el la las le los van von zu zur y".split())
_PARTICLE = "(?:(?:" + "|".join(sorted(_PARTICLES)) + ") )"

#: In order of precedence; `v` is what is replaced.
PATTERNS = {
    "secret": r"""(?i:\b(?P<hint>token|api[_-]?key|secret|password|passwd|access[_-]?key|auth)\b)["']?\s*[=:]\s*["']?(?P<v>[\w+/\-.]{8,}=*)""",
    "email": r"(?P<v>[\w.%+\-]++@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,})",
    "iban": r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![\d.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)",
    "ip6": r"(?<![\w:])(?P<v>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![\d+])(?P<v>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|(?<![.,])0\d{2,4}[ /\-]\d{5,8})(?!\d)",
    "ssn": r"(?<![\d\-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d\-])",
    "number": r"(?<!\d)(?P<v>(?:\d[ \-]?){12,18}\d)(?!\d)",
    "hex": r"\b(?P<v>[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
#: An e-mail at the start of its run of characters: other starts in a long run would be tried in vain.
_EMAIL = re.compile(r"(?<![\w.%+\-])" + PATTERNS["email"])
_PERSON = re.compile(rf"(?<!\w)(?P<title>{_TITLE}(?:\.? {_TITLE})*)\.? (?P<name>{_PARTICLE}*{_WORD}(?: {_PARTICLE}*{_WORD}){{0,2}})")
_DIGIT, _HINT = re.compile(r"\d"), re.compile(r"(?i)token|key|secret|passw|auth")
_TOKENS = re.compile(_WORD)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def canonical(kind: str, value: str) -> str:
    """What all mentions of an entity share. Numbers: their digits, so that separators do not matter."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "number", "ssn"):
        return ("+" if value.startswith("+") else "") + _digits(value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        return value.casefold()
    return value.lower() if kind == "ip6" else value


def space(kind: str) -> str:
    """What a surrogate must be distinct in."""
    return "digits" if kind in ("phone", "ssn", "number") else "ip" if kind == "ip6" else kind


def _base(word: re.Match) -> tuple[int, int]:
    """The span of a word without a possessive s."""
    return word.start(), word.end() - 2 * word[0].endswith(("'s", "\u2019s"))


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, "name", gender by title) of the words of titled names, and of the same words elsewhere in the text."""
    out, known = [], set()
    at = 0
    while m := _PERSON.search(text, at):
        at = m.end("title")
        titles = m["title"].lower().replace(".", "").split()
        gender = next((g for t in titles for g, of in (("m", _MALE), ("f", _FEMALE)) if t in of), "")
        words = []
        for w in _TOKENS.finditer(text, m.start("name"), m.end("name")):
            if w[0] in _PARTICLES:
                continue
            if w[0][0].islower() or w[0].lower() in _TITLES:
                break
            words.append(w)
            at = w.end()
        for w in words:
            s, e = _base(w)
            out.append((s, e, "name", gender if w is not words[-1] else ""))
            known.add(text[s:e])
    if known:
        taken = {s for s, _, _, _ in out}
        for w in _TOKENS.finditer(text):
            s, e = _base(w)
            if e - s > 2 and s not in taken and text[s:e] in known:
                out.append((s, e, "name", ""))
    return out


def _is_secret(m: re.Match) -> bool:
    """Not a plain word: "token = javascript" is none."""
    value = m["v"]
    return m["hint"].lower() in ("password", "passwd") or bool(_DIGIT.search(value)) or not (value.islower() or value.isupper() or value.istitle())


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of the e-mail pattern: at starts of runs, and where another match ends."""
    at = 0
    while m := _EMAIL.search(text, at):
        while m:
            yield m
            at = m.end()
            m = _COMPILED["email"].match(text, at)


def detect(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender: m, f or nothing) of the entities in text, in order and without overlaps.

    Of entities that overlap the first type of PATTERNS counts. Texts are read whole; null and empty ones have none.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    digits, at = bool(_DIGIT.search(text)), "@" in text
    for kind, pattern in _COMPILED.items():
        if kind == "email" and not at or kind == "secret" and not _HINT.search(text) or kind not in ("email", "secret") and not digits:
            continue
        found += [(*m.span("v"), kind, "") for m in (_emails(text) if kind == "email" else pattern.finditer(text)) if (kind != "secret" or _is_secret(m)) and (kind != "ip6" or m["v"].count(":") > 2 and _DIGIT.search(m["v"]))]
    found += _names(text)
    rank = {k: i for i, k in enumerate(PATTERNS)}
    kept: list[tuple[int, int, str, str]] = []
    claimed = bytearray(len(text)) if len(found) > 1 else None
    for s, e, kind, gender in sorted(found, key=lambda x: (rank.get(x[2], 99), x[0])):
        if claimed is not None:
            if any(claimed[s:e]):
                continue
            claimed[s:e] = b"\1" * (e - s)
        kept.append((s, e, kind, gender))
    return [(s, e, kind, canonical(kind, text[s:e]), gender) for s, e, kind, gender in sorted(kept)]


class _Stream:
    """Keyed draws for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        self.key, self.label, self.n, self.pool = key, f"{kind}\0{form}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.label + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def pick(self, of):
        return of[self.below(len(of))]


#: Letters to draw from by script; upper case follows the letter that is replaced.
_SCRIPTS = {"LATIN": string.ascii_lowercase, "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
_VOWELS = {"LATIN": "aeiou", "CYRILLIC": "аеиоу", "GREEK": "αεηιο"}
_ENDINGS = {
    ("LATIN", "m"): ("n", "s", "rt", "o", "k"), ("LATIN", "f"): ("a", "ia", "ina", "elle", "ette"),
    ("CYRILLIC", "m"): ("р", "н", "й", "слав"), ("CYRILLIC", "f"): ("а", "ия", "ина"),
    ("GREEK", "m"): ("ος", "ης", "ας"), ("GREEK", "f"): ("α", "η", "ια"),
}


@cache
def letters(of: str) -> str:
    """The letters of a script to draw from: of those without a list, what Unicode names after it, without upper case."""
    if of in _SCRIPTS:
        return _SCRIPTS[of]
    named = ((c, unicodedata.name(c, "")) for c in map(chr, range(0x250, 0x10000)))
    return "".join(c for c, name in named if name.startswith(f"{of} ") and unicodedata.category(c) in ("Lo", "Ll") and any(k in name for k in (" LETTER", " SYLLABLE", " IDEOGRAPH")))


def script(text: str) -> str:
    """The script of the first letter, as Unicode names it; Latin without any."""
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            return name if letters(name) else "LATIN"
    return "LATIN"


def _shape(value: str, draw: _Stream, hexes: bool = False) -> str:
    """Letters for letters of the same script and case, digits for digits, the rest as it is."""
    out = []
    for c in value:
        if c.isdigit() or hexes and c in "abcdefABCDEF":
            x = draw.pick("0123456789abcdef" if hexes else string.digits)
        elif c.isalpha():
            x = draw.pick(letters(script(c)))
        else:
            x = c
        out.append(x.upper() if c.isupper() else x)
    return "".join(out)


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    value = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(value) % 97:02d}"


def surrogate(kind: str, form: str, key: bytes, gender: str = "", attempt: int = 0, domain: str | None = None) -> str:
    """The canonical form that replaces `form`; other attempts give other draws. domain: the surrogate of a mail address's domain, an
    entity of its own."""
    draw = _Stream(key, kind, form, attempt)
    more = attempt // 8  # tiny formats run out of forms: later draws are longer
    pad = "".join(draw.pick(string.ascii_lowercase) for _ in range(max(1, more)))[:more]
    extra = "".join(draw.pick(string.digits) for _ in range(more - 1))  # of digits, only after the leading ones are drawn too
    if kind == "email":
        local, _, own = form.rpartition("@")
        return f"{_shape(local, draw)}{pad}@{domain or surrogate('domain', own, key)}"
    if kind == "domain":
        return f"{_shape(form.split('.')[0], draw)}{pad}.example.net"
    if kind == "ip6":
        return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
    if kind == "ip":
        a = int(form.split(".")[0])
        if more > 3:  # there are no more addresses of four parts: one of the range that is kept for documents
            return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
        return ".".join(str(x) for x in (10 if a in (10, 127, 172, 192) and not more else 240 + draw.below(15), draw.below(256), draw.below(256), 1 + draw.below(254)))
    if kind in ("phone", "ssn"):
        plus, digits = form.startswith("+"), form.removeprefix("+")
        lead = "9" if kind == "ssn" else digits[: len(digits) - 10] if len(digits) > 10 else digits[:1] if plus else ""
        if more:
            lead = ""
        body = digits[len(lead) :]
        new = _shape(body, draw)
        if kind == "phone" and len(body) == 10:  # the exchange 555 is never given out
            new = new[:3] + "555" + new[6:]
        return "+" * plus + lead + new + extra
    if kind == "number":
        new = form[0] + _shape(form[1:], draw) + extra
        want = luhn(form)
        return next(x for x in (new[:-1] + str((int(new[-1]) + d) % 10) for d in range(10)) if luhn(x) == want)
    if kind == "iban":
        rest = _shape(form[4:], draw) + extra
        return form[:2] + _iban_check(form[:2], rest) + rest
    if kind == "name":
        of = script(form)
        if of not in _VOWELS:
            return "".join(draw.pick(letters(of)) for _ in range(len(form) + more))
        consonants = [c for c in _SCRIPTS[of] if c not in _VOWELS[of] and c not in "qxwyъь"]
        stem = "".join(draw.pick(consonants) + draw.pick(_VOWELS[of]) for _ in range(max(2, min(5, len(form) // 2)) + more))
        if gender in ("m", "f"):
            return stem + draw.pick(consonants) + draw.pick(_ENDINGS[of, gender]) if gender == "f" else stem + draw.pick(_ENDINGS[of, gender])
        return stem + draw.pick(consonants)
    if kind == "hex" and form.startswith(("AKIA", "sk-", "gh")):
        lead = 4 if form.startswith(("AKIA", "gh")) else 3
        return form[:lead] + _shape(form[lead:], draw) + pad
    return _shape(form, draw, hexes=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form))) + pad


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the format of the mention: its separators, its case."""
    if kind in ("phone", "number", "ssn"):
        digits = iter(_digits(new))
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars, "") for c in mention) + "".join(chars)
    if kind in ("email", "name"):
        if len(mention) > 1 and mention.isupper():
            return new.upper()
        return new[:1].upper() + new[1:] if mention[:1].isupper() else new
    return new


FOUND = "start int, end int, kind string, form string, gender string"


def mentions(keyed: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(text_key, start, end, kind, form, gender), once for each text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for found in detect(text.as_py()):
                    keys.append(i)
                    rows.append(found)
            if rows:
                s, e, kind, form, gender = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(kind), pa.array(form), pa.array(gender)], names=["text_key", "start", "end", "kind", "form", "gender"])

    slim = keyed.select(F.col(key_col).alias("text_key"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return slim.mapInArrow(run, f"text_key string, {FOUND}").distinct()


def entities(found: DataFrame) -> DataFrame:
    """(kind, form, gender) of all mentions: a form is one entity, of the gender that most of its mentions give (none if equal)."""
    m, f = (F.count_if(F.col("gender") == g) for g in "mf")
    return found.groupBy("kind", "form").agg(F.when(m > f, "m").when(f > m, "f").otherwise("").alias("gender"))


def assign(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, new) for distinct entities (kind, form, gender); new is distinct within a space() and no real form of it. Addresses
    of one mail domain keep one: domains get their surrogates first."""
    of = F.substring_index("form", "@", -1)
    domains = known.where("kind = 'email'").select(of.alias("form")).distinct()
    own = settle(domains.select(F.lit("domain").alias("kind"), "form", F.lit("").alias("gender"), F.lit(None).cast("string").alias("part")), key)
    parts = known.withColumn("__of", F.when(F.col("kind") == "email", of)).join(own.select(F.col("form").alias("__of"), F.col("new").alias("part")), "__of", "left")
    return settle(parts.select("kind", "form", "gender", "part"), key)


def settle(known: DataFrame, key: bytes) -> DataFrame:
    """assign() for entities (kind, form, gender, part: the surrogate of a mail address's domain).

    Each round draws for the entities still without a surrogate, all at once; of those that draw the same the
    smallest keeps it. Rounds go on until nothing is left, and end because formats get wider; only counts reach the driver.
    """

    def drawing(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, forms, genders, parts = (batch.column(c).to_pylist() for c in range(4))
                new = [surrogate(k, f, key, g, attempt, p) for k, f, g, p in zip(kinds, forms, genders, parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(space, kinds), pa.string()), pa.array(new, pa.string())], names=["kind", "form", "space", "new"])

        return run

    of = F.when(F.col("kind").isin("phone", "ssn", "number"), "digits").when(F.col("kind") == "ip6", "ip").otherwise(F.col("kind"))
    real = known.select(of.alias("space"), F.col("form").alias("new")).distinct()
    pending, done, attempt = known.select("kind", "form", "gender", "part"), None, 0
    while done is None or not pending.isEmpty():
        drawn = pending.mapInArrow(drawing(attempt), "kind string, form string, space string, new string")
        fit = drawn.join(real, ["space", "new"], "left_anti")
        if done is not None:
            fit = fit.join(done, ["space", "new"], "left_anti")
        won = checkpoint(fit.groupBy("space", "new").agg(F.min(F.struct("kind", "form")).alias("e")).select("e.kind", "e.form", "space", "new"))
        done = won if done is None else done.unionByName(won)
        pending = checkpoint(pending.join(won, ["kind", "form"], "left_anti"))
        attempt += 1
    return done.select("kind", "form", "new")


#: Copies of a text are looked up in so many groups, so that none of them holds all.
SALTS = 16


def replace(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every entity in text_col replaced; other columns and rows unchanged. count_col: adds the number of mentions.

    key: the secret of the draws; the same key and corpus give the same surrogates. Texts without entities, null and empty ones
    included, come back as they are; long texts are read whole. Repeated texts get the same surrogates. Columns may have
    any name but count_col's. An empty table gives an empty result.
    """
    mark, spans = unused("__tm_key", docs.columns), unused("__tm_found", docs.columns)
    others = [F.col(c) for c, t in docs.dtypes if c != text_col and "map<" not in t and "variant" not in t]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("string") if others else F.lit("")
    keyed = docs.withColumn(mark, F.concat_ws(":", text_hash(text_col), salt))
    found = materialize(mentions(keyed, mark, text_col), "pii")
    chosen = assign(entities(found), key)
    listed = found.join(chosen, ["kind", "form"]).groupBy(F.col("text_key").alias(mark)).agg(F.collect_list(F.struct("start", "end", "kind", "new")).alias(spans))
    joined = keyed.join(listed, mark, "left")

    @F.pandas_udf("string")
    def rewritten(texts, spans):
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is not None and len(own):
                parts, at = [], 0
                for x in sorted(own, key=lambda x: x["start"]):
                    parts += [text[at : x["start"]], render(x["kind"], text[x["start"] : x["end"]], x["new"])]
                    at = x["end"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    touched = F.col(spans).isNotNull()  # only these texts go to Python
    new = F.when(touched, rewritten(F.when(touched, F.col(text_col)), F.col(spans))).otherwise(F.col(text_col))
    out = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if count_col:
        out.append(F.when(touched, F.size(spans)).otherwise(0).alias(count_col))
    return joined.select(*out)


def session_key(spark) -> bytes:
    """The key of a run: the setting spark.tidemark.pii.key; where it is unset, a key for demonstrations, which keeps nothing secret."""
    return (spark.conf.get("spark.tidemark.pii.key", None) or "demonstration").encode()


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, the number of entities replaced, and the text with surrogates, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, session_key(spark), count_col="n_entities").select("doc_id", "n_entities", "text")
