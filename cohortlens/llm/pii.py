"""Surrogates for personal data.

Detected entities (e-mail and IP addresses, phone, card, social security and account numbers, secrets, names after a form of
address, and those names where they stand alone later or earlier in the same text) get replacements that are a keyed function of the entity: HMAC(key, type, canonical form, attempt). So
the same entity has the same surrogate in every document and spelling (a phone number with or without brackets, a surname with or
without the given name), which keeps coreference without a shared table. Surrogates keep type and format: letters stay letters of
their case, digits digits, separators stay, card numbers stay valid or invalid, names keep script, case and the gender of the form of address.

Within a text a name is one person's wherever it stands: if it is a given name once, or the form of address tells a gender once, all
its mentions follow (a name with both genders is two persons'). Domains of e-mail addresses are entities of their own, so an address is distinct if its domain is and its local part is within the domain.

Distinctness is checked over the whole corpus: distinct entities are counted by Spark, and while two of one type (all parts of names are one type) share a surrogate,
or a surrogate is itself an entity of the corpus, all but the first take their next attempt. From the attempt ``GROWS`` on domains, local parts and names get longer, so
a used-up format ends too; types whose format can't grow fail after ``MOST`` attempts instead of sharing a surrogate. Only entities with an
attempt above 0 (hardly any) are joined back to the documents that mention them. The key is the caller's: who has it can redo the mapping.

Null texts stay null; texts without entities stay as they are. Rows are independent, repeated rows get equal results. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.tables import Scratch, beside, pick, table

#: key of the registered query alone, whose results are to be the same in every run
QUERY_KEY = b"cohortlens"
#: from this attempt on a surrogate may be an entity of the corpus (a format that is nearly used up)
LENIENT = 16
#: every so many attempts a surrogate that may grow gets a letter more
GROWS = 8
MOST = 200

# Forms of address and the gender they tell, prefixes of secrets, names of settings that hold secrets.
ADDRESS = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Srta": "f", "Doña": "f",
    "госпожа": "f", "Κυρία": "f", "Dr": "n", "Prof": "n",
}
SECRET_HEADS = r"AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xoxb-|xoxp-|AIza"
SECRET_NAMES = r"token|secret|password|passwd|api[_-]?key|access[_-]?key"

PATTERN = re.compile("|".join([
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    rf"(?P<secret>(?<![A-Za-z0-9])(?:{SECRET_HEADS})[A-Za-z0-9_-]{{16,}}|(?<![A-Za-z0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}})(?![A-Za-z0-9]))",
    rf"(?:{SECRET_NAMES})[\"']?\s*[=:]\s*[\"'](?P<setting>[^\"'\s]{{6,}})[\"']",
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    r"(?P<ip>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9]))",
    r"(?P<ip6>(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9]))",
    r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    r"(?P<card>(?<![0-9])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}"
    r"|(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)(?:[ -]?[0-9]{4}){3})(?![0-9]))",
    r"(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|(?:1[ .-])?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    r"|(?:1 )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4})(?![0-9A-Za-z]))",
]))
HINT = re.compile(r"[0-9@]|" + SECRET_NAMES)
PARTICLES = "de|del|della|der|den|di|da|dos|du|la|le|van|von|zu|ter|ten|bin|ibn|al|el"
WORD = r"(?:[^\W\d_a-z]['’][^\W\d_a-z][^\W\d_]+|[dl]['’][^\W\d_a-z][^\W\d_]+|[^\W\d_a-z][^\W\d_]+(?:-[^\W\d_]+)?)"
BEFORE = rf"(?:(?:{PARTICLES}) |[^\W\d_a-z]\. ?){{0,3}}"
PERSON = re.compile(r"(?<!\w)(" + "|".join(ADDRESS) + rf")\.? ({BEFORE}{WORD}(?: {BEFORE}{WORD}){{0,2}})(?!\w)")
#: the replaced parts of a name: not its initials and particles
NAME = re.compile(rf"(?<!\w)(?!(?:{PARTICLES}) )(?:[^\W\d_]['’][^\W\d_]{{2,}}|[^\W\d_]{{2,}})")

DIGITS = {"ip", "ssn", "card", "phone"}
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", "a", "n"),
    "cyrillic": ("бвгдклмнпрст", "аеиоу", "а", "в"),
    "greek": ("βγδκλμνπρστ", "αειου", "α", "ς"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) in text order."""
    out = []
    if HINT.search(text):
        for m in PATTERN.finditer(text):
            kind = m.lastgroup
            lo, hi = m.span(kind)
            raw = m[kind]
            kind = "secret" if kind == "setting" else kind
            canon = raw
            if kind == "email":
                canon = raw.lower()
            elif kind == "ip":
                canon = raw
            elif kind == "ip6":
                try:
                    canon = ipaddress.IPv6Address(raw).exploded
                except ValueError:  # a time, a hardware address
                    continue
                if len(re.findall(r"[0-9A-Fa-f]+", raw)) < 2:
                    continue
            elif kind in DIGITS or kind == "iban":
                canon = re.sub(r"[^0-9A-Za-z]", "", raw)
                if kind == "card" and (not 13 <= len(canon) <= 19 or canon[0] == "2" and not luhn(canon)):
                    continue
                if kind == "phone":
                    if len(canon) == 11 and canon[0] == "1":
                        canon = canon[1:]
                    if not 7 <= len(canon) <= 15:
                        continue
            out.append((lo, hi, kind, canon))
    parts = []
    kinds: dict[str, list[str]] = {}
    for m in PERSON.finditer(text):
        gender = ADDRESS[m[1]]
        words = [(w.start() + m.start(2), w.end() + m.start(2), w[0]) for w in NAME.finditer(m[2])]
        for i, (lo, hi, w) in enumerate(words):
            kind = f"given-{gender}" if len(words) > 1 and i == 0 else "surname"
            parts.append((lo, hi, kind, w.lower()))
            kinds.setdefault(w.lower(), []).append(kind)
    names = {w: _one_kind(ks) for w, ks in kinds.items()}
    for lo, hi, kind, w in parts:
        two = {"given-m", "given-f"} <= set(kinds[w])
        out.append((lo, hi, kind if two and kind[-2:] in ("-m", "-f") else names[w], w))
    clean = _apart(sorted(out))
    if names:  # the same names without a form of address, where nothing else stands
        alone = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
        taken = iter([*clean, (len(text), len(text))])
        now = next(taken)
        more = []
        for m in alone.finditer(text):
            while now[1] <= m.start() < len(text) and now[0] < len(text):
                now = next(taken)
            kind = names.get(m[0].lower())
            if kind and m.end() <= now[0] and (m[0][0].isupper() or m[0][1] in "'’"):
                more.append((*m.span(), kind, m[0].lower()))
        clean = sorted(clean + more)
    return clean


def _one_kind(kinds: list[str]) -> str:
    """What a name is in a text: given with the first gender told, given, or a surname."""
    told = [k for k in kinds if k in ("given-m", "given-f")]
    return told[0] if told else "given-n" if "given-n" in kinds else "surname"


def _apart(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The first of those that overlap."""
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


class Stream:
    """Numbers drawn from HMAC blocks."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.left = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x = int.from_bytes(self.left[:4], "big")
        self.left = self.left[4:]
        return x % n


def _like(text: str, s: Stream, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    out = []
    for c in text:
        if c in "0123456789":
            out.append(str(s.below(10)))
        elif c.isascii() and c.isalpha():
            x = letters[s.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _longer(s: Stream, attempt: int) -> str:
    return "".join(chr(97 + s.below(26)) for _ in range(attempt // GROWS))


def surrogate(key: bytes, kind: str, canon: str, attempt: int, domain_attempt: int = 0) -> str:
    """The canonical form of the replacement; an address also needs the attempt of its domain."""
    s = Stream(key, kind, canon, str(attempt))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        return f"{_like(local, s)}{_longer(s, attempt)}@{surrogate(key, 'domain', domain, domain_attempt)}"
    if kind == "domain":
        host, _, top = canon.rpartition(".")
        return f"{_like(host, s)}{_longer(s, attempt)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ip6":
        return ":".join("123456789abcdef"[s.below(15)] + "".join("0123456789abcdef"[s.below(16)] for _ in range(3)) for _ in range(8))
    if kind == "card":
        body = canon[0] + _like(canon[1:-1], s)
        good = [d for d in "0123456789" if luhn(body + d) == luhn(canon)]
        return body + good[s.below(len(good))]
    if kind == "iban":
        return canon[:2] + _like(canon[2:], s, "abcdefghjklmnprstuvwxyz")
    if kind == "secret":
        head = re.match(SECRET_HEADS, canon)
        head = head[0] if head else ""
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
            digits = "0123456789ABCDEF" if canon.upper() == canon else "0123456789abcdef"
            return "".join(digits[s.below(16)] for _ in canon)
        return head + _like(canon[len(head):], s)
    if kind == "surname" or kind.startswith("given"):
        con, vow, fem, masc = SCRIPTS[_script(canon)]
        name = "".join(con[s.below(len(con))] + vow[s.below(len(vow))] for _ in range(2 + s.below(2) + attempt // 4))
        return name[:-1] + fem if kind == "given-f" else name + masc if kind == "given-m" else name + con[s.below(len(con))]
    return _like(canon, s)


def render(kind: str, raw: str, new: str) -> str:
    """The surrogate in the mention's own format."""
    if kind in ("ssn", "card", "phone", "iban"):
        old = re.sub(r"[^0-9A-Za-z]", "", raw)
        new = old[: len(old) - len(new)] + new  # a country code that the canonical form leaves out
        it = iter(new)
        return "".join(next(it) if c.isascii() and c.isalnum() else c for c in raw)
    if kind == "surname" or kind.startswith("given"):
        return new.upper() if raw.isupper() and len(raw) > 1 else new.capitalize()
    if kind in ("email", "ip6") and raw.isupper():
        return new.upper()
    return new


def _compared(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """What has to differ: domains differ by themselves, so addresses are compared within their domain."""
    new = surrogate(key, kind, canon, attempt)
    return f"{new.rpartition('@')[0]}@{canon.rpartition('@')[2]}" if kind == "email" else new


def _with_domains(found: set[tuple[str, str]]) -> set[tuple[str, str]]:
    return found | {("domain", c.rpartition("@")[2]) for k, c in found if k == "email"}


def _entities(batches: Iterator[pa.RecordBatch]):
    seen: set[tuple[str, str]] = set()

    def out():
        rows = sorted(seen)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "canon"])

    for b in batches:
        for t in b.column(0):
            t = t.as_py()
            if t:
                seen |= _with_domains({(k, c) for _, _, k, c in mentions(t)})
        if len(seen) > 100_000:
            yield out()
            seen.clear()
    yield out()


def _named(key: bytes):
    def run(batches):
        for b in batches:
            kind, canon, attempt = (b.column(i).to_pylist() for i in range(3))
            new = [_compared(key, *x) for x in zip(kind, canon, attempt)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])
    return run


ENTITY = "kind string, canon string, attempt int, new string"


def distinct_surrogates(entities: DataFrame, key: bytes, tmp: Scratch) -> DataFrame:
    """(kind, canon, attempt, new) with one ``new`` for each entity of a type, none shared."""
    name = _named(key)
    pool = F.expr("if(kind = 'surname' or kind like 'given-%', 'name', kind)")
    got = tmp.put(entities.select("kind", "canon", F.lit(0).alias("attempt")).mapInArrow(name, ENTITY))
    while True:
        pooled = got.withColumn("pool", pool)
        first = pooled.groupBy("pool", "new").agg(F.min(F.struct("attempt", "kind", "canon")).alias("f"), F.count("*").alias("n"))
        shared = pooled.join(first.filter("n > 1"), ["pool", "new"]).filter("canon <> f.canon or kind <> f.kind").select("kind", "canon")
        real = (pooled.filter(f"attempt < {LENIENT} and kind <> 'email'").join(pooled.select("pool", F.col("canon").alias("new")), ["pool", "new"], "left_semi")
                .select("kind", "canon"))
        again = tmp.put(shared.unionByName(real).distinct())
        if not again.limit(1).count():
            return got
        next_try = tmp.put(got.join(again, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        full = next_try.filter(F.col("attempt") > MOST).select("kind").first()
        if full:
            raise ValueError(f"no distinct surrogates are left for {full['kind']}")
        new = tmp.put(got.join(again, ["kind", "canon"], "left_anti").unionByName(next_try.mapInArrow(name, ENTITY)))
        tmp.drop(got, again, next_try)
        got = new


def _replace(key: bytes):
    kind_t = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for b in batches:
            texts, spans = [], []
            for t, special in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = mentions(t) if t else []
                if found:
                    tries = {(x["kind"], x["canon"]): x["attempt"] for x in special or ()}
                    parts, at = [], 0
                    for lo, hi, kind, canon in found:
                        domain = tries.get(("domain", canon.rpartition("@")[2]), 0) if kind == "email" else 0
                        new = surrogate(key, kind, canon, tries.get((kind, canon), 0), domain)
                        parts += [t[at:lo], render(kind, t[lo:hi], new)]
                        at = hi
                    t = "".join([*parts, t[at:]])
                texts.append(t)
                spans.append([{"kind": k, "lo": lo, "hi": hi} for lo, hi, k, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, kind_t)], names=["id", "text", "spans"])
    return run


def _mentioned(batches):
    for b in batches:
        rows = [(i, k, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for k, c in _with_domains({(x[2], x[3]) for x in mentions(t)})]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["id", "kind", "canon"])


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes) -> DataFrame:
    """(id_col, text, n_entities, spans): the text with surrogates, and what was replaced (in code points of the input)."""
    tmp = Scratch(docs.sparkSession)
    src = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    entities = src.select("text").mapInArrow(_entities, "kind string, canon string").distinct()
    named = distinct_surrogates(entities, key, tmp)
    later = tmp.put(named.filter("attempt > 0").select("kind", "canon", "attempt"))
    special = "array<struct<kind:string,canon:string,attempt:int>>"
    if later.limit(1).count():
        told = (src.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(_mentioned, "id string, kind string, canon string")
                .join(later, ["kind", "canon"]).groupBy("id").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("special")))
        rows = src.join(told.withColumnRenamed("id", "t"), F.expr("cast(id as string) = t"), "left").select("id", "text", "special")
    else:
        rows = src.select("id", "text", F.lit(None).cast(special).alias("special"))
    out = rows.mapInArrow(_replace(key), beside(src, "id", "text string, spans array<struct<kind:string,lo:int,hi:int>>"))
    return out.select(F.col("id").alias(id_col), "text", F.size("spans").cast("long").alias("n_entities"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"), key=QUERY_KEY)
