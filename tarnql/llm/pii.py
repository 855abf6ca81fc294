"""Personal data in texts, with DataFrame functions only.

For each kind a regular expression proposes spans; a text is split by it once for the
gaps and once for the matches, and running sums of their lengths give the offsets.
Checksums confirm: Luhn for cards, mod-97 for account numbers, ranges for addresses and
for security numbers.  Words near a candidate raise its score; kinds whose pattern alone
says little are reported only with such words or a checksum.

The patterns are those of the contract with possessive quantifiers and a look behind,
which change no match but make a failed attempt linear.  Running sums are taken in
blocks, so a text with very many matches costs no quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on either side of a candidate in which words count as near it.
NEAR = 40
#: Least score of a reported span of a kind that isn't one of the four base kinds.
REPORT = 0.6
#: Matches that fit into that many characters, at most: none is shorter than five.
AROUND = NEAR // 5
BLOCK = 128

_octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column) -> Column:
    return let(_digits(x), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))


def _mod97(x: Column) -> Column:
    """Account numbers: letters become numbers, the first four signs go to the end, the rest must be 1 modulo 97."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    signs = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(signs, F.lit(0), lambda r, v: F.pmod(F.when(v > 9, r * 100 + v).otherwise(r * 10 + v), F.lit(97)))
    return F.length(plain).between(15, 34) & (rest == 1)


#: Countries of the registry of account numbers, by their numbers' length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_iban = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())


def _security(x: Column) -> Column:
    return ~x.rlike("^(?:000|666|9)") & ~x.rlike("-00-") & ~x.rlike("-0000$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this has no span of the kind.
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    bonus: float
    base: bool = True
    #: The sign before and after a span mustn't match these.
    before: str = field(default="")
    after: str = field(default="")


KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", "@",
        lambda x: F.lit(True), 0.9, r"e-?mail|contact|write to|mailto", 0.1,
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
        lambda x: x.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$"), 0.6, r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|server|host|client", 0.3,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", _card, 0.8, r"card|visa|master|credit|debit|payment|cvv", 0.2),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
        lambda x: F.length(_digits(x)).between(10, 15), 0.7, r"phone|(?:^|[^a-z])tel|call|mobile|fax|contact", 0.3,
    ),
    Kind(
        "iban", _iban, "[A-Z]{2}[0-9]{2}", _mod97, 0.8, r"iban|account|bank|konto|compte|cuenta", 0.2,
        base=False, before="[A-Za-z0-9]", after="[A-Za-z0-9]",
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-", _security, 0.4, r"(?:^|[^a-z])ssn(?:[^a-z]|$)|social security|security number", 0.5,
        base=False, before="[0-9-]", after="[0-9-]",
    ),
    Kind(
        "localphone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", "[0-9]{3}[.-][0-9]{4}", lambda x: F.lit(True), 0.4, r"phone|(?:^|[^a-z])tel|call|mobile|fax", 0.4,
        base=False, before="[0-9+.-]", after="[0-9.-]",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts: sums of the lengths before it, in blocks of ``BLOCK``."""
    pairs = F.zip_with(
        F.transform(F.slice(gaps, 1, F.size(matches)), F.length), F.transform(matches, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m"))
    )

    def blocked(ps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda b: F.slice(ps, b * BLOCK + 1, F.lit(BLOCK)))
        # (start of the next block, starts of the blocks so far)
        first = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("all")),
            lambda a, b: F.struct(
                (a["at"] + F.aggregate(b, F.lit(0), lambda s, p: s + p["g"] + p["m"])).alias("at"), F.array_append(a["all"], a["at"]).alias("all")
            ),
        )
        inner = F.zip_with(
            blocks,
            first["all"],
            lambda b, at: F.aggregate(
                b,
                F.struct(at.alias("at"), F.expr("CAST(array() AS array<int>)").alias("all")),
                lambda a, p: F.struct((a["at"] + p["g"] + p["m"]).alias("at"), F.array_append(a["all"], a["at"] + p["g"]).alias("all")),
            )["all"],
        )
        return F.flatten(inner)

    return F.when(F.size(matches) == 0, F.expr("CAST(array() AS array<int>)")).otherwise(let(pairs, blocked))


def spans(text: Column, kind: Kind) -> Column:
    """Array of (at, rank, end, kind, value, score) of one kind in a text that isn't null."""
    rank = KINDS.index(kind)

    def found(gaps: Column, matches: Column, starts: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            # gaps and matches on either side, as many as NEAR characters can hold
            left = F.transform(F.sequence(F.greatest(i - AROUND, F.lit(0)), i), lambda j: F.right(F.concat(F.when(j > 0, matches[F.greatest(j - 1, F.lit(0))]).otherwise(F.lit("")), gaps[j]), F.lit(NEAR)))
            right = F.transform(F.sequence(i + 1, F.least(i + 1 + AROUND, F.size(gaps) - 1)), lambda j: F.left(F.concat(gaps[j], F.when(j < F.size(gaps) - 1, matches[F.least(j, F.size(gaps) - 2)]).otherwise(F.lit(""))), F.lit(NEAR)))
            near = F.lower(F.concat(F.right(F.array_join(left, ""), F.lit(NEAR)), F.lit(" "), F.left(F.array_join(right, ""), F.lit(NEAR))))
            valid = kind.valid(value)
            if kind.before:
                valid &= ~F.right(gaps[i], F.lit(1)).rlike(kind.before)
            if kind.after:
                valid &= ~F.left(gaps[i + 1], F.lit(1)).rlike(kind.after)
            score = F.when(near.rlike(kind.context), F.lit(round(kind.score + kind.bonus, 2))).otherwise(F.lit(kind.score))
            return F.when(
                valid,
                F.struct(
                    starts[i].alias("at"), F.lit(rank).alias("rank"), (starts[i] + F.length(value)).alias("end"), F.lit(kind.name).alias("kind"),
                    value.alias("value"), score.alias("score"),
                ),
            )

        kept = F.filter(F.transform(matches, one), lambda s: s.isNotNull())
        return kept if kind.base else F.filter(kept, lambda s: s["score"] >= REPORT)

    cut = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"))
    all_of_them = let(cut, lambda c: let(_starts(c["gaps"], c["matches"]), lambda at: found(c["gaps"], c["matches"], at)))
    needed = F.contains(text, F.lit(kind.needs)) if kind.needs == "@" else text.rlike(kind.needs)
    nothing = F.expr("CAST(array() AS array<struct<at:int,rank:int,end:int,kind:string,value:string,score:double>>)")
    return F.when(needed, all_of_them).otherwise(nothing)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of every row: ``found`` lists the spans by start, then kind.

    Offsets count code points and ends are exclusive.  A null text is an empty one, with
    no spans.  Columns other than doc_id and text are ignored.
    """
    whole = F.coalesce("text", F.lit(""))
    # most texts have neither a digit nor an @: one look decides
    worth = whole.rlike("[0-9@]")
    rows = docs.select("doc_id", F.when(worth, whole).otherwise(F.lit("")).alias("text"))
    return rows.select("doc_id", F.sort_array(F.concat(*[spans(F.col("text"), k) for k in KINDS])).alias("found"))


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base kinds' spans, all spans and their scores, for every row.

    A null text counts as an empty one; repeated rows and rows without an id are told once
    each; an empty table gives an empty result.  Columns other than doc_id and text are ignored.
    """
    found = find(docs)
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    both = docs.select(F.struct("doc_id", "text").alias("d")).select("d", F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"))
    whole = F.coalesce("text", F.lit(""))
    rows = both.select("doc_id", "text", F.sort_array(F.concat(*[spans(whole, k) for k in KINDS])).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(whole, acc["at"] + 1, F.greatest(s["at"] - acc["at"], F.lit(0))), F.when(s["at"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.array_append(acc["parts"], piece).alias("parts"))

    done = F.aggregate("found", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(whole, a["at"] + 1)))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), done).alias("text"))


def _oracle() -> str:
    """The digests in SQL for another engine, with the contract's own patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
    }
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(
        f"({quote(k.name)}, {rank}, {quote(plain.get(k.name, k.pattern))}, {quote(k.context)}, {k.score}, {round(k.score + k.bonus, 2)}, {quote(k.before or '$^x')}, {quote(k.after or '$^x')})"
        for rank, k in enumerate(KINDS)
    )
    base = ", ".join(map(quote, BASE))
    counts = ", ".join(f"count(*) FILTER (kind = {quote(k)}) AS n_{k}" for k in BASE)
    zeros = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, rank, pattern, context, low, high, before, after) AS (VALUES {values}),
m AS (
  SELECT r, t, k.*, string_split_regex(t, pattern) AS g, regexp_extract_all(t, pattern) AS v FROM d, k
  WHERE regexp_matches(t, '[0-9@]') AND regexp_matches(t, pattern)
),
x AS (
  SELECT *, CASE WHEN regexp_matches(lower(substring(t, greatest(1, a + 1 - {NEAR}), least(a, {NEAR})) || ' ' || substring(t, a + length(v) + 1, {NEAR})), context) THEN high ELSE low END AS score
  FROM (SELECT r, t, kind, rank, context, low, high, v[i] AS v, g[i] AS gb, g[i + 1] AS ga, before, after, regexp_replace(v[i], '[^0-9]', '', 'g') AS digits,
         CAST(list_sum(list_transform(g[1 : i], lambda s: length(s))) + coalesce(list_sum(list_transform(v[1 : i - 1], lambda s: length(s))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m))
),
ok AS (
  SELECT r, kind, rank, a, a + length(v) AS b, score FROM (SELECT *, replace(v, ' ', '') AS p FROM x)
  WHERE CASE kind
    WHEN 'email' THEN TRUE
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda s: length(ltrim(s, '0')) > 3 OR CAST('0' || left(ltrim(s, '0'), 3) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN CAST(reverse(digits)[j] AS INTEGER) ELSE 2 * CAST(reverse(digits)[j] AS INTEGER) - CASE WHEN CAST(reverse(digits)[j] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN length(p) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(p[5:] || p[1:4], ''), lambda c:
      CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda q, n: CASE WHEN n > 9 THEN (q * 100 + n) % 97 ELSE (q * 10 + n) % 97 END) = 1
    WHEN 'ssn' THEN NOT regexp_matches(v, '^(?:000|666|9)') AND NOT regexp_matches(v, '-00-') AND NOT regexp_matches(v, '-0000$')
    ELSE TRUE END
  AND NOT regexp_matches(right(gb, 1), before) AND NOT regexp_matches(left(ga, 1), after)
  AND (kind IN ({base}) OR score >= {REPORT})
),
s AS (
  SELECT r, {counts},
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FILTER (kind IN ({base})) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans,
         string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY a, rank, b) AS scores
  FROM ok GROUP BY r
)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN s ON d.r = s.r
"""


ORACLE = _oracle()
