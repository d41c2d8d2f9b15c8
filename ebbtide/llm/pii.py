"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

Everything is SQL on the row itself: no shuffle, no Python. A text without the
characters a kind needs skips that kind's patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The proposing patterns. Possessive repeats and look-behinds change no match;
# they keep the work linear and the matcher's stack flat on very long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    `needs`: SQL on `{t}` that is true for every text with a match.
    `valid`: SQL on the match `m`. A span's score is `prior`, plus `boost` if a word of
    `words` stands in the 40 characters before it; spans under `least` are dropped.
    """
    name: str
    pattern: str
    needs: str
    valid: str
    prior: float
    boost: float
    words: str
    least: float = 0.0


def _digits(m: str) -> str:
    return f"length(regexp_replace({m}, '[^0-9]', ''))"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


LUHN = _let("reverse(regexp_replace(m, '[^0-9]', ''))", "d", """
    aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE
        WHEN i % 2 = 1 THEN int(substr(d, i, 1))
        WHEN int(substr(d, i, 1)) > 4 THEN 2 * int(substr(d, i, 1)) - 9
        ELSE 2 * int(substr(d, i, 1)) END) % 10 = 0""")
MOD97 = """aggregate(split(concat(substr(m, 5), substr(m, 1, 4)), ''), 0, (a, c) -> CASE
        WHEN c = '' THEN a
        WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97
        ELSE (a * 10 + int(c)) % 97 END) = 1"""

KINDS = (
    Kind("email", EMAIL, "contains({t}, '@')", "true", 0.8, 0.15, "mail|contact|write|address"),
    Kind("ip", IP, r"{t} rlike r'[0-9]\.[0-9]'",
         "forall(split(m, r'\\.'), x -> length(ltrim('0', x)) <= 3 AND cast(concat('0', x) AS double) <= 255)",
         0.6, 0.3, "ip|host|server|address|from"),
    Kind("card", CARD, r"{t} rlike r'[0-9](?:[\x20-]?[0-9]){{15}}'",
         f"CASE WHEN {_digits('m')} BETWEEN 16 AND 19 THEN {LUHN} ELSE false END", 0.7, 0.25,
         "card|visa|credit|pay|debit"),
    Kind("phone", PHONE, r"{t} rlike r'\+[0-9]'", f"{_digits('m')} BETWEEN 8 AND 15", 0.6, 0.3,
         "phone|call|tel|mobile|fax"),
    Kind("iban", IBAN, r"{t} rlike r'[A-Z][A-Z][0-9][0-9][A-Z0-9]{{11}}'", MOD97, 0.9, 0.1, "iban|account|bank"),
    Kind("ssn", SSN, r"{t} rlike r'[0-9]-[0-9]{{2}}-[0-9]'",
         "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9'", 0.3, 0.5, "ssn|social|security|insurance",
         0.5),
)
BASE = ("email", "ip", "card", "phone")
BLOCK = 512


def _starts(pieces: str, found: str) -> str:
    """Start (code points) of every match, from the texts between them: sums by blocks, then within one."""
    return _let(f"zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> bigint(length(p) + length(m)))", "w", _let(
        f"""aggregate(transform(sequence(0, (size(w) - 1) div {BLOCK}), b ->
                aggregate(slice(w, int(b * {BLOCK} + 1), {BLOCK}), 0L, (a, x) -> a + x)),
            named_struct('t', 0L, 'a', cast(array() AS array<bigint>)),
            (s, x) -> named_struct('t', s.t + x, 'a', concat(s.a, array(s.t)))).a""", "o",
        f"""transform(sequence(1, size(w)), i -> o[(i - 1) div {BLOCK}]
            + aggregate(slice(w, int((i - 1) div {BLOCK} * {BLOCK} + 1), int((i - 1) % {BLOCK} + 1)), 0L, (a, x) -> a + x)
            - length({found}[i - 1]))"""))


def _spans(text: str, k: Kind) -> str:
    none = "cast(array() AS array<struct<kind:string,start:bigint,`end`:bigint,score:double>>)"
    near = f"lower(right(p[i], {CONTEXT_CHARS})) rlike r'\\b(?:{k.words})'"
    score = f"{k.prior}D + CASE WHEN {near} THEN {k.boost}D ELSE 0D END"
    # The validator sees the match as m.
    each = _let("f[i]", "m", f"""CASE WHEN {k.valid} AND {score} >= {k.least}D THEN
        named_struct('kind', '{k.name}', 'start', s[i], 'end', s[i] + length(m), 'score', {score}) END""")
    body = _let(f"regexp_extract_all(t, r'{k.pattern}', 0)", "f", f"""CASE WHEN size(f) = 0 THEN {none} ELSE """
                + _let(f"split(t, r'{k.pattern}')", "p", _let(_starts("p", "f"), "s", f"""
        filter(transform(sequence(0, size(f) - 1), i -> {each}), x -> x IS NOT NULL)""")) + " END")
    return f"CASE WHEN {k.needs.format(t=text)} THEN {_let(text, 't', body)} ELSE {none} END"


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with `out`: array of (kind, start, end, score), by kind as listed, then start.

    Positions are code points, the end exclusive. A null or empty text has no spans. Rows are
    independent: repeated rows get equal answers; other columns pass through, and one that is
    called like `out` is replaced. Very long texts are scanned whole.
    """
    t = "`__pii_text`"
    cols = [f"`__pii_{k.name}`" for k in KINDS]
    keep = [c for c in docs.columns if c != out]
    df = docs.withColumn("__pii_text", F.expr(f"coalesce(`{text}`, '')"))
    df = df.select(*[f"`{c}`" for c in keep], *[F.expr(_spans(t, k)).alias(f"__pii_{k.name}") for k in KINDS])
    return df.select(*[f"`{c}`" for c in keep], F.expr(f"concat({', '.join(cols)})").alias(out))


def mask_pii(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` with every span scoring at least `least` written as `<KIND>`; overlapping spans are joined."""
    found = find_pii(docs, text, "__pii")
    order = f"sort_array(transform(filter(__pii, x -> x.score >= {least}D), x -> struct(x.start, x.`end`, x.kind)))"
    # Pieces of clean text between spans: (text so far, position reached).
    masked = f"""aggregate({order}, named_struct('a', cast(array() AS array<string>), 'at', 0L),
        (s, x) -> CASE WHEN x.start < s.at THEN named_struct('a', s.a, 'at', greatest(s.at, x.`end`)) ELSE
            named_struct('a', concat(s.a, array(substr(`{text}`, int(s.at + 1), int(x.start - s.at)), concat('<', upper(x.kind), '>'))),
                         'at', x.`end`) END,
        s -> concat(array_join(s.a, ''), substr(`{text}`, int(s.at + 1))))"""
    return found.withColumn(text, F.expr(f"CASE WHEN size(__pii) = 0 THEN `{text}` ELSE {masked} END")).drop("__pii")


def digest(found: DataFrame, spans: str = "pii") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = ", ".join(f"'{k}'" for k in BASE)
    line = "transform({0}, x -> concat_ws(':', x.kind, cast(x.start AS string), cast(x.`end` AS string)))"
    return found.select(
        "doc_id", *[F.expr(f"bigint(size(filter({spans}, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2(array_join({line.format(f'filter({spans}, x -> x.kind IN ({base}))')}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join({line.format(spans)}, ',')").alias("spans"),
        F.expr(f"coalesce(array_max(transform({spans}, x -> x.score)), 0D)").alias("top_score"))
