"""PII: detected entities are replaced by keyed surrogates of the same type and format.

Detection is by pattern and context: e-mail addresses, phone numbers, payment cards (with a right check digit), IBANs (with a
right checksum), social security numbers, IPv4 and IPv6 addresses, street addresses, secrets (an assignment to a token-like
name, keys of well-known forms, PEM private keys) and persons: a listed given name in any case but lower, the capitalised words
after it (also after initials and particles) or after a title, and these surnames wherever else the text has them.

Each entity has a canonical form (letter case and punctuation removed), and its surrogate is a keyed function of the type and
that form, so an entity has one surrogate in all documents (coreference), whatever way it is written:

- digits become digits, letters letters, in the shape of the mention; cards and IBANs keep right check digits, phone numbers
  their country code, IBANs their country, addresses their kind of street, keys their prefix; e-mail addresses get a domain
  under ``example``, equal domains an equal one;
- a given name becomes one of the same gender and script by a keyed permutation of its list, a surname one of the same
  script, each by itself, so that a full name and its parts stay consistent.

Distinctness is checked over the corpus: where two entities have the same surrogate, or one has a surrogate that is itself an
entity of the corpus, all but the first draw again until none is left. Later draws are longer where the format allows it, so a
crowded type (one-letter mailboxes) finds room; a type of digits whose numbers are used up raises an error. What is written
on the way are keyed digests and shapes (``a.a0@`` and a digest), never an entity itself. Texts are read whole, twice.

The key is an argument, or ``spark.tapeworks.surrogateKey``; without one, a random key is drawn for the process, and nobody can
link its surrogates to another run's.

Defined results: null and empty texts have no entities and stay as they are. Rows with equal ids share their redraws. A null
id is a document like any other. Overlapping matches: the earlier, then the longer one wins. Other columns pass through,
whatever their names; one called ``_tw_entities`` makes place for the result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROW, discard, from_row, id_key, with_row, written

KEY_SETTING = "spark.tapeworks.surrogateKey"
#: Draws after which surrogates grow by a letter each time, and after which a type of digits is given up.
GROW_AFTER, MAX_DRAWS = 6, 64

# Given names by gender and script, and particles and titles that stand before surnames.
GIVEN = {
    ("f", "latin"): "Anna Maria Mary Julia Laura Sarah Emma Sophie Claudia Helen Alice Carla Lucia Lucía Elena Marta Ingrid Greta Camille Chloe Chloé Amelie Natalie Lisa Olivia Aisha Jane Susan Linda Karen Nancy Ursula Sabine Monika Petra Isabel Carmen Pilar Ana Céline Brigitte Nathalie Fatima Emily Jessica".split(),
    ("m", "latin"): "Peter Thomas Michael Daniel David Robert Carlos Miguel Pedro Pablo Hans Klaus Stefan Andreas Pierre Antoine Julien Nicolas James William John José Javier Juan Luis Jorge Jean François Michel Jacques Jürgen Wolfgang Günter Heinz Richard Charles George Paul Mark Steven Ahmed Mohammed Ali Martin".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Алексей Николай Андрей Михаил Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης".split(),
}
TITLES = set("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Don Doña Monsieur Madame Mme Mlle Господин Госпожа Κύριος Κυρία".split())
PARTICLES = set("von van de der den del la di da du le bin ibn al".split())
# Country calling codes of two digits; 1 and 7 have one digit, all others three.
CALLING_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_SYLLABLES = {"latin": "ba den kor lin mar nel ros sten tal vik wer zan", "cyrillic": "ба ден кор лин мар нел рос стен тал вик вер зан", "greek": "βα δεν κορ λιν μαρ νελ ροσ στεν ταλ βικ βερ ζαν"}
_NAME_OF = {form: (group, name) for group, names in GIVEN.items() for name in names for form in (name, name.upper())}

_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_SECRET = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)\s*[=:]\s*[\"']?([\w/+.\-]{12,}=*)")
_KEY_SIGNS = ("AKIA", "AIza", "eyJ", "sk-", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_KEY = re.compile(r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|AIza[\w-]{35}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}|sk-[\w-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|gh[pousr]_[A-Za-z0-9]{36,})(?![\w-])")
_KEY_PREFIX = re.compile(r"AKIA|AIza|eyJ|sk-|xox[abprs]-|gh[pousr]_|")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----\s*([^-]+?)\s*-----END \1PRIVATE KEY-----")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![\w:.]\w)")
#: Tried only where a number may begin, which keeps the search linear and fast.
_START = re.compile(r"[\d+(]")
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square)\b"
_NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\d))"
    rf"|(?P<address>(?<![\w.,-])\d{{1,5}}[a-z]?,? (?:(?:[A-ZÀ-Þ][\w'’-]*\.? ){{1,4}}{_STREET}|(?:rue|avenue|boulevard|place|chemin) (?:(?:de|du|des|la|le) |d'|l')*[A-ZÀ-Þ][\w'’-]+))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d))"
)
#: Streets whose number comes last; looked for only before a number.
_BEFORE = re.compile(r"(?:[A-ZÀ-Þ][\w-]*(?:straße|strasse|gasse|allee|platz|weg)|(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|los|las) )*[A-ZÀ-Þ]\w+,?) \Z")
_HOUSE = re.compile(r"\d{1,4}[a-z]?(?!\w)")
_CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]\w+(?:['’-]\w{2,})*")
#: Between a given name and a surname: initials and particles.
_GAP = re.compile(r"[  ](?:[A-ZÀ-Þ]\.[  ]?)*((?:\w+ )*)\Z")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")


def _checked(digits: str) -> bool:
    """The Luhn check of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    end = 0
    for start in _START.finditer(text):
        at = start.start()
        if at < end:
            continue
        before = _BEFORE.search(text, max(0, at - 60), at) if text[at].isdigit() and text[at - 1 : at] == " " else None
        if before and (m := _HOUSE.match(text, at)):
            end = m.end()
            yield before.start(), end, "address", text[before.start() : end]
        elif m := _NUMBER.match(text, at):
            kind, form = m.lastgroup, re.sub(r"\D", "", m[0])
            if kind == "card" and not _checked(form):
                end = m.end()
                continue
            end = m.end()
            yield *m.span(), kind, m[0] if kind in ("ip", "address") else "+" + form if m[0][0] == "+" else form


def _persons(text: str) -> Iterator[tuple[int, int, str, str]]:
    after, titled, surnames = None, False, set()
    for m in _CAPITAL.finditer(text):
        word = m[0]
        named = _NAME_OF.get(word)
        gap = text[after : m.start()] if after is not None and m.start() - after < 40 else None
        if named is not None:
            yield *m.span(), "given", named[1]
            after, titled = m.end(), False
        elif word in TITLES:
            after, titled = m.end(), True
        elif gap is not None:
            between = _GAP.match(gap.removeprefix(".") if titled else gap)
            if between and set(between[1].split()) <= PARTICLES:
                surnames.add(word.lower())
            after, titled = (m.end(), False) if titled and between else (None, False)
        elif "A" <= word[0] <= "Z" and word[2:4].isdigit() and (iban := _IBAN.match(text, m.start())):
            form = iban[0].replace(" ", "")
            if 15 <= len(form) <= 34 and _iban_rest(form) == 1:
                yield *iban.span(), "iban", form
    if surnames:  # also where they stand alone
        for m in _CAPITAL.finditer(text):
            if m[0].lower() in surnames and m[0] not in _NAME_OF:
                yield *m.span(), "surname", m[0].lower()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities, in order and without overlaps."""
    found, at = [], text.find("@")
    while at >= 0:
        a, m = at, _DOMAIN.match(text, at + 1)
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        if m and a < at and text[at - 1] not in ".+-":
            found.append((a, m.end(), "email", text[a : m.end()].lower()))
        at = text.find("@", at + 1)
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text)]
        for m in _IP6.finditer(text):
            try:
                found.append((*m.span(), "ip6", ipaddress.IPv6Address(m[0]).exploded))
            except ValueError:
                pass
    if any(sign in text for sign in _KEY_SIGNS):
        found += [(*m.span(), "secret", m[0]) for m in _KEY.finditer(text)]
    if "-----BEGIN" in text:
        found += [(*m.span(2), "secret", m[2]) for m in _PEM.finditer(text)]
    found += _numbers(text)
    found += _persons(text)
    out, end = [], 0
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


class _Stream:
    """Keyed pseudo-random numbers."""

    def __init__(self, key: bytes, *said):
        self.key, self.said, self.block, self.pool = key, "\x00".join(map(str, said)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.digest(self.key, self.said + self.block.to_bytes(4, "big"), hashlib.sha256)
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n


def digest(key: bytes, kind: str, form: str) -> str:
    return hmac.digest(key, f"{kind}\x00{form}".encode(), hashlib.sha256)[:16].hex()


def _script(word: str) -> str:
    return "cyrillic" if re.match("[Ѐ-ӿ]", word) else "greek" if re.match("[Ͱ-Ͽἀ-῿]", word) else "latin"


def _pattern(word: str) -> str:
    """0 for digits, h or H for those of hexadecimal words, a letter of the script and case for letters, others as they are."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", word) and not word.isdigit():
        return ("H" if word.upper() == word else "h") * len(word)
    first = {"latin": "a", "cyrillic": "а", "greek": "α"}
    return "".join("0" if c.isdigit() else (x.upper() if c.isupper() else x) if c.isalpha() and (x := first[_script(c)]) else c for c in word)


def _street(address: str) -> str:
    """An address with its numbers and names as patterns (one capital A for a name) but the words for its kind of street."""
    keep = rf"{_STREET}|Calle|Avenida|Plaza|Paseo"
    name = r"[A-ZÀ-Þ][\w'’-]*?(straße|strasse|gasse|allee|platz|weg)?(?!\w)"
    return re.sub(rf"({keep})|{name}|(\d+)", lambda m: m[1] or ("0" * len(m[3]) if m[3] else "A" + (m[2] or "")), address)


@lru_cache(100_000)
def shape(key: bytes, kind: str, form: str) -> str:
    """What of an entity its surrogate must match; with the digest, all that is written of it."""
    if kind == "email":
        local, _, domain = form.partition("@")
        return f"{_pattern(local)}@{digest(key, 'domain', domain)}"
    if kind == "phone":
        if form[0] != "+":
            return form[: len(form) - len(form.lstrip("0"))][:1] + "#" * (len(form) - form.startswith("0"))
        n = 1 if form[1] in "17" else 2 if form[1:3] in CALLING_CODES else 3
        return form[: n + 1] + "#" * (len(form) - n - 1)
    if kind == "iban":
        return form[:2] + _pattern(form[4:])
    if kind == "secret":
        prefix = _KEY_PREFIX.match(form)[0]
        return prefix + "\x00" + _pattern(form[len(prefix) :])
    if kind == "address":
        return _street(form)
    return {"surname": _script(form), "ip": "4", "ip6": "6", "domain": ""}.get(kind, "#" * len(form))


def _filled(s: _Stream, pattern: str) -> str:
    out = []
    for c in pattern:
        if c == "0":
            out.append(str(s.below(10)))
        elif c in "hH":
            x = "0123456789abcdef"[s.below(16)]
            out.append(x.upper() if c == "H" else x)
        elif c in "aAаАαΑ":
            x = chr({"a": 97, "а": 0x430, "α": 0x3B1}[c.lower()] + s.below(26 if c in "aA" else 16))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _word(s: _Stream, script: str, more: int) -> str:
    parts = _SYLLABLES[script].split()
    return "".join(parts[s.below(12)] for _ in range(3 + s.below(2) + more))


@lru_cache(64)
def _permuted(key: bytes, gender: str, script: str) -> dict[str, str]:
    left, s = list(GIVEN[gender, script]), _Stream(key, "given", gender, script)
    for k in range(len(left) - 1, 0, -1):
        j = s.below(k + 1)
        left[k], left[j] = left[j], left[k]
    return dict(zip(left, left[1:] + left[:1]))  # one cycle through all names: no name stays itself


@lru_cache(100_000)
def surrogate(key: bytes, kind: str, of: str, shape: str, draw: int = 0) -> str:
    """The canonical form that stands for the entity of this digest and shape; an e-mail's domain remains a digest."""
    s, more = _Stream(key, kind, of, draw), max(0, draw - GROW_AFTER)
    if kind == "surname":
        return _word(s, shape, more)
    if kind == "domain":
        return f"{''.join(chr(97 + s.below(26)) for _ in range(8 + more))}.example.{('com', 'net', 'org')[s.below(3)]}"
    if kind == "email":
        local, _, domain = shape.partition("@")
        return f"{_filled(s, local + 'a' * more)}@{domain}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ip6":
        return "2001:0db8:" + ":".join(f"{s.below(1 << 16):04x}" for _ in range(6))
    if kind == "secret":
        prefix, _, rest = shape.partition("\x00")
        return prefix + _filled(s, rest + "a" * more)
    if kind == "address":
        made = re.sub("A(?![a-rt-z])", lambda m: _word(s, "latin", more).capitalize(), re.sub("A(?=straße|strasse|gasse|allee|platz|weg)", lambda m: _word(s, "latin", more).capitalize(), shape))
        return re.sub("0+", lambda m: str(1 + s.below(9)) + "".join(str(s.below(10)) for _ in m[0][1:]), made)
    if kind == "iban":
        body = _filled(s, shape[2:])
        return f"{shape[:2]}{98 - _iban_rest(f'{shape[:2]}00{body}'):02d}{body}"
    if kind == "card":
        body = str(1 + s.below(9)) + "".join(str(s.below(10)) for _ in shape[2:])
        return body + next(d for d in "0123456789" if _checked(body + d))
    return "".join(str(s.below(10)) if c == "#" else c for c in shape)


def _shaped(kind: str, mention: str, made: str) -> str:
    """The surrogate's canonical form in the shape of the mention."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(made.removeprefix("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        signs = iter(made)
        return "".join(c if c == " " else next(signs) for c in mention)
    if kind in ("given", "surname"):
        return made.upper() if mention.isupper() else made if kind == "given" else made.capitalize()
    return str(ipaddress.IPv6Address(made)) if kind == "ip6" else made


def replace(text: str, key: bytes, draws: dict[tuple[str, str], int]) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, canonical form, surrogate) of each mention. draws: by type and digest."""
    parts, end, made = [], 0, []
    for a, b, kind, form in find(text):
        if kind == "given":
            new = _permuted(key, *_NAME_OF[form][0])[form]
        else:
            of = digest(key, kind, form)
            new = surrogate(key, kind, of, shape(key, kind, form), draws.get((kind, of), 0))
        if kind == "email":
            local, _, domain = new.partition("@")
            new = f"{local}@{surrogate(key, 'domain', domain, '', draws.get(('domain', domain), 0))}"
        parts += [text[end:a], _shaped(kind, text[a:b], new)]
        made.append((kind, form, new))
        end = b
    return ("".join([*parts, text[end:]]), made) if made else (text, made)


def _mentions(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """Documents to (_tw_id, kind, of, shape) of their entities, and of the domains of e-mail addresses. Given names need none."""
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            said = {e[2:] for e in find(t.as_py())} if t.is_valid else set()
            said |= {("domain", form.partition("@")[2]) for kind, form in said if kind == "email"}
            rows += [(i, kind, digest(key, kind, form), shape(key, kind, form)) for kind, form in said if kind != "given"]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["_tw_id", "kind", "of", "shape"])


def _draw(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """Adds the surrogate, and its digest as if it were an entity itself."""
    for batch in batches:
        kind, of, form, draw = (batch.column(k).to_pylist() for k in range(4))
        made = [surrogate(key, *x) for x in zip(kind, of, form, draw)]
        real = [digest(key, k, m) for k, m in zip(kind, made)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), pa.array(real, pa.string())], ["kind", "of", "shape", "draw", "made", "made_of"])


def redraws(mentions: DataFrame, key: bytes) -> DataFrame:
    """(kind, of, draw) of the entities whose first surrogate is taken, or is an entity of the corpus itself."""
    entities = written(mentions.select("kind", "of", "shape").distinct(), "entities")
    real = entities.select("kind", F.col("of").alias("made_of"), F.lit(True).alias("real"))
    drawn = lambda df: df.select("kind", "of", "shape", "draw").mapInArrow(lambda it: _draw(it, key), "kind string, of string, shape string, draw int, made string, made_of string")
    taken = written(drawn(entities.withColumn("draw", F.lit(0))), "surrogates")
    for _ in range(MAX_DRAWS):
        rank = F.row_number().over(Window.partitionBy("kind", "made").orderBy("draw", "of"))
        judged = taken.withColumn("rank", rank).join(real, ["kind", "made_of"], "left").withColumn("clash", (F.col("rank") > 1) | F.col("real").isNotNull())
        judged = written(judged.select("kind", "of", "shape", "draw", "made", "made_of", "clash"), "surrogates")
        discard(taken)
        if judged.filter("clash").isEmpty():
            out = written(judged.filter("draw > 0").select("kind", "of", "draw"), "redraws")
            discard(entities, judged)
            return out
        again = drawn(judged.filter("clash").withColumn("draw", F.col("draw") + 1))
        taken = written(judged.filter("not clash").drop("clash").unionByName(again), "surrogates")
        discard(judged)
    raise ValueError("an entity type has too few surrogates for the corpus")


def _rewrite(batches: Iterator[pa.RecordBatch], key: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, entities = [], []
        for t, redrawn in zip(batch.column(1), batch.column(2)):
            new, made = (None, []) if not t.is_valid else replace(t.as_py(), key, {(r["kind"], r["of"]): r["draw"] for r in redrawn.as_py() or []})
            texts.append(new)
            entities.append([{"kind": k, "surrogate": s} for k, _, s in made])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), pa.array(texts, pa.string()), pa.array(entities, schema.field(2).type)], schema=schema)


@lru_cache(1)
def _random_key() -> bytes:
    return secrets.token_bytes(32)


def surrogate_key(spark: SparkSession) -> bytes:
    said = spark.conf.get(KEY_SETTING, None)
    return said.encode() if said else _random_key()


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with surrogates in ``text``, plus ``_tw_entities``: type and surrogate of each mention, in order."""
    key = key or surrogate_key(docs.sparkSession)
    source = docs.select(id_key(doc_id).alias("_tw_id"), F.col(text).cast("string").alias("_tw_text"))
    mentions = written(source.mapInArrow(lambda it: _mentions(it, key), "_tw_id long, kind string, of string, shape string"), "mentions")
    taken = redraws(mentions, key)
    again = mentions.join(taken, ["kind", "of"]).groupBy("_tw_id").agg(F.collect_set(F.struct("kind", "of", "draw")).alias("_tw_redrawn"))
    again = written(again, "redrawn")
    discard(mentions, taken)
    rows = with_row(docs, (text,), _tw_id=id_key(doc_id), _tw_text=F.col(text).cast("string")).join(again, "_tw_id", "left")
    schema = T.StructType([rows.schema[ROW], T.StructField("_tw_text", T.StringType()), T.StructField("_tw_entities", T._parse_datatype_string("array<struct<kind:string,surrogate:string>>"))])
    arrow = to_arrow_schema(schema)
    out = rows.select(ROW, "_tw_text", "_tw_redrawn").mapInArrow(lambda it: _rewrite(it, key, arrow), schema)
    return from_row(out, docs.columns, **{text: "_tw_text", "_tw_entities": "_tw_entities"})


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("_tw_entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("_tw_entities.kind")), ",").alias("kinds"))
