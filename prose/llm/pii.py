"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Four base kinds (email, ip, card, phone) are found leftmost and without overlap per kind and always
reported. The method adds kinds that a pattern alone would get wrong: IBANs confirmed by mod-97,
secrets (runs of 20 or more key characters with a digit) and social security numbers. Every span has a
score: its kind's start value, raised by words of the kind on either side and lowered by words that
speak against it. Spans of the added kinds need ``MIN_SCORE``; a caller can ask it of the base kinds too.

Cases with a defined result: null or empty text has no spans; repeated rows are treated one by one;
spans of several kinds that start together come in the order of ``KINDS``; an empty table gives an empty
result; other columns are passed through untouched by ``mask`` and ignored by ``find``. All scans are
linear in the text, however long its runs of digits or letters, and no span has a greatest length but
those that a standard sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties between spans that start together.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = 4
#: Spans of the added kinds need this score.
MIN_SCORE = 0.5
#: Characters on either side of a span in which context words count.
CONTEXT_CHARS = 60
RAISED, LOWERED = 0.4, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
# Score of a kind by itself, and words nearby that raise it, in English, German, French and Spanish.
_START_SCORE = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.2, "secret": 0.2}
_CONTEXT = {
    kind: re.compile(rf"(?i)(?<!\w)(?:{words})(?!\w)")
    for kind, words in {
        "email": r"e-?mail|mail|contact|kontakt|correo|courriel|contacto",
        "ip": r"ip|address|host|server|adresse|dirección|serveur|servidor",
        "card": r"card|credit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta|crédito|crédit",
        "phone": r"phone|tel|telephone|call|mobile|fax|telefon|anruf|handy|téléphone|appel|portable|teléfono|móvil|llamar",
        "iban": r"iban|account|bank|transfer|konto|überweisung|compte|banque|virement|cuenta|banco|transferencia",
        "ssn": r"ssn|social security|tax id|sozialversicherung(?:snummer)?|steuernummer|sécurité sociale|numéro fiscal|seguridad social|número fiscal",
        "secret": r"token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|passwort|kennwort|schlüssel|geheimnis|mot de passe|clé|jeton|contraseña|clave|secreto",
    }.items()
}
# Fixed value: words nearby that speak against personal data.
_AGAINST = re.compile(r"(?i)(?<!\w)(?:version|release|build|isbn|example|sample|beispiel|exemple|ejemplo|versión)(?!\w)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban_length(found: str) -> int:
    """Length of the longest valid number at the start; later groups of capitals may be ordinary words."""
    while found and not mod97(found):
        found = found.rpartition(" ")[0]
    return len(found)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, leftmost first: for each @, the longest local part before it that
    does not reach into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _scored(kind: str, text: str, start: int, end: int) -> float:
    before, after = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    near = lambda pattern: pattern.search(before) or pattern.search(after)
    score = _START_SCORE[kind] + RAISED * bool(near(_CONTEXT[kind])) - LOWERED * bool(near(_AGAINST))
    return min(1.0, max(0.0, round(score, 6)))


def _proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, index in KINDS) of all spans that a pattern proposes and a checksum or range confirms."""
    if "@" in text:
        yield from ((a, b, 0) for a, b in _emails(text))
    first = _DIGIT.search(text)
    if not first:
        return
    at = first.start()
    for m in _IP.finditer(text, at):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
            yield m.start(), m.end(), 1
    for m in _CARD.finditer(text, at):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), 2
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield m.start(), m.end(), 3
    for m in _IBAN.finditer(text):
        if size := _iban_length(m[0]):
            yield m.start(), m.start() + size, 4
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), 5
    for m in _SECRET.finditer(text):
        if _DIGIT.search(m[0]):
            yield m.start(), m.end(), 6


def spans(text: str, min_base_score: float = 0.0) -> list[tuple[int, int, int, float]]:
    """(start, end, index in KINDS, score) of all spans by start, then kind; end is exclusive."""
    out = []
    for a, b, kind in _proposed(text):
        score = _scored(KINDS[kind], text, a, b)
        if score >= (min_base_score if kind < BASE_KINDS else MIN_SCORE):
            out.append((a, b, kind, score))
    return sorted(out)


def _joined(found: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in found)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for a, b, k, _ in spans(text):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, stop, score>> of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "stop": b, "score": s} for a, b, k, s in spans(t.as_py() or "")]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, stop long, score double>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``find``: counts of the base kinds, their digest and all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE_KINDS]))
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:BASE_KINDS]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns with spans masked in ``text`` and ``n_chars``, where there is one, set anew. Null text stays null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def hide(texts):
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn("text", hide("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
