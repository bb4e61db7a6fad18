"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of their own type and format. A surrogate is the
image of the entity's canonical form under a keyed permutation of all strings of the same shape (letters
stay letters of their script and case, digits stay digits, check digits stay right), so different
entities of a shape never meet and mentions of one entity, in any layout or case, stay one. What a
permutation can't rule out is checked over the whole corpus: an entity that would stay itself, a surrogate
that is another entity's real value, and surrogates that meet across shapes or tries. The losers
take the next try until none is left, for names with one syllable more, so that there is always room;
only these exceptions are carried to the documents.

Names are found after a title, word by word: the last word is a family name, the others are given names of the
title's gender; where the same document mentions a word of them again without a title, it is replaced too. Initials, particles
between names and the ending of a possessive are no names and stay.
Not found are names that no title introduces in their document, and personal data in words (places, dates, employers).
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallframe.llm.graph import checkpointed
from tallframe.llm.text import map_batches

#: Scripts whose letters are permuted among themselves, titles by gender, name syllables and endings.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "αβγδεζηθικλμνξοπρστυφχψως", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
TITLES = {"mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "sir": "m", "mister": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "señorita": "f", "madame": "f", "mme": "f", "mlle": "f", "mademoiselle": "f", "dr": "n", "prof": "n", "professor": "n", "doctor": "n", "κύριος": "m", "κυρία": "f", "господин": "m", "госпожа": "f"}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "sa", "to", "va", "zu", "ri", "lo"], "greek": ["βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρε", "σα", "το", "ζα", "θυ", "ρι", "λο"], "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "са", "то", "ва", "зу", "ри", "ло"]}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "", "s": "r"}, "greek": {"m": "ς", "f": "να", "n": "", "s": "ρ"}, "cyrillic": {"m": "н", "f": "на", "n": "", "s": "р"}}

LETTERS = r"[^\W\d_]"
WORD = rf"[^\W\d_a-z]{LETTERS}*(?:['’-]{LETTERS}+){{0,5}}"
CALLED = [f for t in TITLES for f in (t.capitalize(), t.upper())]
#: Particles of names, titles that are told in small letters, words between two titles.
PARTICLES = "af al av bin da dal das de del della den der di do dos du e el ibn la le ten ter van von y zu zum zur".split()
SMALL = ["mr", "mrs"]
BETWEEN = ["and", "or"]
GAP = r"[^\S\r\n]{1,3}"
PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}){GAP}){{0,3}}"
INITIALS = r"(?:[^\W\d_a-z]\.[^\S\r\n]{0,3}){0,4}"
NAME = rf"{INITIALS}{PARTICLE}{WORD}(?:{GAP}{INITIALS}{PARTICLE}{WORD}){{0,2}}"
#: Every part is bounded or starts at the first letter of a run alone, so that a search is linear in the text.
PATTERNS = {
    "email": r"(?<![\w.+-])(?=[.+-]{0,64}\w)[\w.+-]{1,320}@[\w-]{1,63}(?:\.[\w-]{1,63}){0,20}\.[^\W\d_]{2,63}(?![\w-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-fA-F]{32,128}|(?<!-)xox[abeprs]-[A-Za-z0-9-]{10,512}|(?<![_-])eyJ[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{4,8192}\.[A-Za-z0-9_-]{4,4096})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|(?<![.-])\d{3}(?P<sep>[.-])\d{3}(?P=sep)\d{4}(?![.-]\d)|(?<!\d[ .-])(?:00[1-9]\d{0,2}[ .-]\d{1,5}(?:[ .-]\d{2,8}){1,4}|0\d(?:[ .-]\d{2}){4}|0\d{2,4} \d{3,4} \d{3,4}|[2-9]\d{2} \d{3} \d{4})(?![ .-]\d))(?!\d)",
    "name": rf"\b(?:(?P<title>{'|'.join(CALLED)})\b\.?\s{{1,4}}(?P<name>{NAME})|(?P<small>{'|'.join(SMALL)})\b\.?\s{{1,4}}(?:(?P<named>{NAME})|(?!(?:{'|'.join(BETWEEN)})\b)(?P<low>{LETTERS}{{2,64}})))",
}
ENTITY = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS.items()))
SECRET = re.compile(r"\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*[\"']?(?P<secret>[A-Za-z0-9_+/=.-]{8,})", re.I)
DIGIT = re.compile(r"\d")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: What a text without digits and the signs of mail, keys and addresses must hold for anything to be found.
TELLING = re.compile(rf"AKIA|gh[pousr]_|sk-|xox|eyJ|[a-fA-F]{{32}}|\b(?:{'|'.join([*CALLED, *SMALL])})\b")
#: Words as names may be mentioned, their parts, and the ending of a possessive.
MENTION = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
OF_MENTION = re.compile(r"[^\W_]+")
OWN = re.compile(r"['’][sS]$")


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` and it a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def lowered(value: str) -> str:
    """Lower case, letter by letter and only where that stays one letter."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def raised(value: str) -> str:
    return "".join(up if len(up := c.upper()) == 1 else c for c in value)


def again(text: str, called: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """Where names are mentioned, as words or parts of words with hyphens or apostrophes: one look at each part, whatever the number of names."""
    out: list[tuple[int, int, str, str]] = []
    if not called:
        return out
    most = max(len(OF_MENTION.findall(w)) for w in called)
    for m in MENTION.finditer(text):
        if (kind := called.get(lowered(m[0]))) and m[0][0].isupper():
            out.append((*m.span(), kind, m[0]))
            continue
        parts = [x.span() for x in OF_MENTION.finditer(text, *m.span())]
        k = 0
        while len(parts) > 1 and k < len(parts):
            for j in range(min(len(parts), k + most), k, -1):
                found = text[parts[k][0] : parts[j - 1][1]]
                if found[0].isupper() and (kind := called.get(lowered(found))):
                    out.append((parts[k][0], parts[j - 1][1], kind, found))
                    k = j - 1
                    break
            k += 1
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """The entities of a text: start, end, kind and canonical form, in order and without overlap."""
    if "@" not in text and "=" not in text and ":" not in text and not DIGIT.search(text) and not TELLING.search(text):
        return []  # most texts, at the cost of a few scans
    out, called = [], {}
    spans = [(*m.span("secret"), "key", m["secret"]) for m in SECRET.finditer(text)] if "=" in text or ":" in text else []
    for m in ENTITY.finditer(text):
        kind = next(k for k in PATTERNS if m[f"k_{k}"] is not None)
        if kind == "card" and not 13 <= len(re.sub(r"\D", "", m[0])) <= 19:
            continue
        if kind != "name":
            spans.append((*m.span(), kind, m[0]))
            continue
        group = next(g for g in ("name", "named", "low") if m[g] is not None)
        words = [(m.start(group) + w.start(), OWN.sub("", w[0])) for w in re.finditer(rf"{LETTERS}+(?:['’-]{LETTERS}+)*", m[group])]
        if group != "low":
            words = [(at, w) for at, w in words if w not in PARTICLES]
            words = words[: next((k for k, (_, w) in enumerate(words) if not w[0].isupper() and w[0].lower() != w[0].upper()), len(words))]
        words = [(at, w) for at, w in words if len(w) > 1]
        gender = TITLES[(m["title"] or m["small"]).lower()]
        for k, (start, w) in enumerate(words):
            kind = "name-s" if k == len(words) - 1 else f"name-{gender}"
            kind = called.setdefault(lowered(w), kind)
            spans.append((start, start + len(w), kind, w))
    spans += again(text, {w: kind for w, kind in called.items() if len(w) > 2})
    last = 0
    for start, end, kind, value in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= last and (form := canonical(kind, value)):
            out.append((start, end, kind, form))
            last = end
    return out


def canonical(kind: str, value: str) -> str | None:
    """The form that all mentions of an entity share; none if it is no entity after all."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":  # a name of a program's scope isn't one
        try:
            return str(ipaddress.IPv6Address(value)) if DIGIT.search(value) and len(value) > 6 else None
        except ValueError:
            return None
    if kind in ("email", "ip") or kind.startswith("name"):
        return lowered(value)
    return value.lower() if HEX.fullmatch(value) else value


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below ``size``: a Feistel network, walked until it falls below."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def step(r: int, right: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{r}|".encode() + right.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width)).digest() * (1 + width // 64), "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            left, right = right, left ^ step(r, right)
        x = left << half | right
        if x < size:
            return x


def reshaped(value: str, key: bytes, tweak: str) -> str:
    """Permutes the letters and digits of a string as one number; everything else stays."""
    places = [(i, a, c.isupper()) for i, c in enumerate(value) for a in ALPHABETS if lowered(c) in a]
    number, size = 0, 1
    for i, a, _ in places:
        number = number * len(a) + a.index(lowered(value[i]))
        size *= len(a)
    shape = "".join("u" if u else "l" for _, _, u in places)
    number = permuted(number, size, key, f"{tweak}|{shape}") if size > 1 else number
    out = list(value)
    for i, a, upper in reversed(places):
        number, k = divmod(number, len(a))
        out[i] = raised(a[k]) if upper else a[k]
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate of a canonical form."""
    tweak = f"{kind}|{attempt}"
    if kind == "ip":
        n = permuted(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, key, tweak)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(permuted(int(ipaddress.IPv6Address(value)), 1 << 128, key, tweak)))
    if kind == "card":  # the issuer's digit stays, and so does whether the number is valid
        valid = luhn(value[:-1]) == int(value[-1])
        body = reshaped(value[1:-1], key, f"{tweak}|{value[0]}|{valid}")
        check = luhn(value[0] + body)
        return value[0] + body + str(check if valid else (check + 1 + (int(value[-1]) - luhn(value[:-1]) - 1) % 10) % 10)
    if kind == "phone" and len(value) > 7:  # the first digit stays, that of a country as a rule, and so do zeros before it
        first = max(1, len(value) - len(value.lstrip("0")))
        return value[:first] + reshaped(value[first:], key, f"{tweak}|{value[:first]}")
    if kind == "iban":
        body = reshaped(value[4:], key, tweak)
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "email":
        at = value.rindex(".")
        return reshaped(value[:at], key, tweak) + value[at:]
    if kind.startswith("name"):
        script = next((s for s, a in (("greek", ALPHABETS[3]), ("cyrillic", ALPHABETS[4])) if any(c in a for c in value)), "latin")
        raw = hashlib.shake_256(key + f"|{tweak}|{value}".encode("utf-8", "surrogatepass"))
        parts = re.split(r"(['’-])", value)
        sizes = [max(2, min(4, len(x) // 2)) + attempt if k % 2 == 0 else 0 for k, x in enumerate(parts)]
        drawn = iter(raw.digest(sum(sizes)))
        return "".join("".join(SYLLABLES[script][next(drawn) % 16] for _ in range(n)) if n else x for x, n in zip(parts, sizes, strict=True)) + ENDINGS[script][kind[-1]]
    if len(value) >= 32 and HEX.fullmatch(value):
        return f"{permuted(int(value, 16), 16 ** len(value), key, tweak):0{len(value)}x}"
    return reshaped(value, key, tweak)


def laid_out(kind: str, original: str, new: str) -> str:
    """The surrogate in the layout and case of a mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in original)
    letters = [c for c in original if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and (len(letters) > 1 or not kind.startswith("name")):
        return raised(new)
    if kind.startswith("name"):
        if original[:1].islower():
            return new
        return "".join(w[:1].upper() + w[1:] for w in re.split(r"(['’-])", new))
    if kind == "email" and any(c.isupper() for c in letters):
        return "".join(raised(n) if o.isupper() else n for o, n in zip(original, new, strict=True))
    return new


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """From the distinct entities ``kind, value`` to those whose first surrogate can't stand: ``kind, value, made``."""

    def with_attempts(df: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def make(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, v, key, a) for k, v, a in zip(kind, value, attempt, strict=True)])

        return df.withColumn("made", make("kind", "value", "attempt"))

    now = checkpointed(with_attempts(entities.withColumn("attempt", F.lit(0))))
    real = entities.select(F.col("kind").alias("k"), F.col("value").alias("made"))
    while True:
        kind = F.split("kind", "-")[0]
        best = now.groupBy(kind.alias("k"), "made").agg(F.min(F.struct("attempt", "value")).alias("best"), F.count("*").alias("n"))
        taken = real.select(F.split("k", "-")[0].alias("k"), "made").distinct().withColumn("taken", F.lit(True))
        bad = best.join(taken, ["k", "made"], "left").where("n > 1 or taken")
        state = now.withColumn("k", kind).join(bad, ["k", "made"], "left")
        loses = F.col("n").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.col("best.value") != F.col("value")) | (F.col("best.attempt") != F.col("attempt")))
        losers = checkpointed(state.where(loses).select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        if losers.isEmpty():
            return now.where("attempt > 0").select("kind", "value", "made")
        stay = now.join(losers.select("kind", "value"), ["kind", "value"], "left_anti")
        now = checkpointed(stay.unionByName(with_attempts(losers)))


def replace_pii(docs: DataFrame, key: str, *, doc_id: str = "doc_id", text: str = "text", most: int = 100_000) -> DataFrame:
    """Replaces personal data in ``text`` by surrogates and adds ``n_entities`` and ``kinds`` (how many of each kind).

    All columns of ``docs`` are kept; ones of the new names are replaced. A null text stays null with no
    entities. Null ids are ids like others. Repeated rows and mentions get equal surrogates, in this corpus and, but for collisions, in any
    other under the same key. An empty table gives no rows. Up to ``most`` exceptions are broadcast; more
    are joined to the documents that mention them.
    """
    secret = hashlib.sha256(key.encode()).digest()

    def mentions(b: dict[str, list]) -> dict[str, list]:
        return {"found": [sorted({(k, v) for _, _, k, v in find(t)}) if t else [] for t in b[text]]}

    base = docs.withColumn("_row", F.xxhash64(doc_id, text))
    found = map_batches(base.select("_row", text), {"found": "array<struct<kind:string,value:string>>"}, mentions, read=[text], keep=["_row"])
    found = checkpointed(found.where(F.size("found") > 0).select("_row", F.explode("found").alias("e")).select("_row", "e.kind", "e.value").distinct())
    bad = checkpointed(exceptions(found.select("kind", "value").distinct(), secret))
    many = bad.count()
    known: dict[tuple[str, str], str] = {}
    if many > most:
        own = found.join(bad, ["kind", "value"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "value", "made")).alias("_made"))
        base = base.join(own, "_row", "left")
    else:
        known = {(r.kind, r.value): r.made for r in bad.collect()}
        base = base.withColumn("_made", F.lit(None).cast("array<struct<kind:string,value:string,made:string>>"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {text: [], "n_entities": [], "kinds": []}
        for t, made in zip(b[text], b["_made"], strict=True):
            own = {(x["kind"], x["value"]): x["made"] for x in made or []}
            parts, last, kinds = [], 0, {}
            for start, end, kind, value in find(t) if t else []:
                new = own.get((kind, value)) or shared.value.get((kind, value)) or surrogate(kind, value, secret)
                parts += [t[last:start], laid_out(kind, t[start:end], new)]
                last = end
                kinds[kind.split("-")[0]] = kinds.get(kind.split("-")[0], 0) + 1
            out[text].append("".join([*parts, t[last:]]) if parts else t)
            out["n_entities"].append(sum(kinds.values()))
            out["kinds"].append(sorted(kinds.items()))
        return out

    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    done = map_batches(base, {text: "string", "n_entities": "bigint", "kinds": "map<string,bigint>"}, work, read=[text, "_made"], keep=[c for c in keep if c != text])
    return done.select(*keep, "n_entities", "kinds")
