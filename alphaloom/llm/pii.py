"""Personal data in DataFrame functions only: format-preserving Feistel pseudonyms.

One pattern finds candidates, and which of its alternatives matched tells the kind; each
candidate is validated, and what isn't valid stays as it is:

* card: 13 to 19 digits (single spaces or hyphens between them) that pass the Luhn test;
  all digits but the last are permuted and the check digit is computed anew. In a row of
  numbers with spaces between, the longest valid one from each number on is taken, and the
  search goes on behind it;
* ssn: ddd-dd-dddd outside the ranges never issued; permuted within the valid ones;
* phone: + country code and more, 8 to 15 digits in all, up to where a value of another kind
  begins, or (ddd) ddd-dddd; the digits after the country code are permuted, however they
  are grouped, so one number gets one pseudonym in every spelling;
* ipv4: four numbers up to 255 without leading zeros; permuted among all addresses;
* ipv6: eight groups, or fewer with one '::'; permuted among all addresses, written in full;
* date: a day of 1700 to 2099 as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd-mm-yyyy,
  mm/dd/yyyy (or dd/mm/yyyy where only that is a day); permuted among these 146,097 days;
* iban: an account number with a valid check number (modulo 97); its digits are permuted and
  the check number is computed anew;
* email and secret (an assigned token, password or key of 16 or more characters, quoted or,
  with a letter and a digit, bare; an access key id): these have no bounded number format,
  so a keyed digest in their form replaces them.

The permutation is an alternating Feistel network on Z_a x Z_b (a * b is exactly the
size of the format, so no cycle walking is needed) with SHA-256 under the key as the round
function: a bijection within the format, equal values get equal pseudonyms in every
document, and who has the key can undo it. Digits are put back between the separators
they stood between. There is no default key: callers pass one, and the query and the pipeline
take `spark.alphaloom.pii.key`; where that is unset they draw a fresh one for the
application, so values stay linked within a run and nobody can undo it afterwards.

Defined results: null text gives null text and zero counts; empty text stays empty; rows
that repeat give repeated results; an empty table gives an empty one; other columns are
ignored (pseudonymise() keeps them, whatever their names). No length is capped.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import table

ROUNDS = 8
KEY_CONF = "spark.alphaloom.pii.key"

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}+(?![A-Za-z0-9])"
_IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_DAY = "(?<![0-9./-])(?:" + "|".join([f"[0-9]{{4}}{m}[0-9]{{2}}{m}[0-9]{{2}}" for m in "-/"] + [f"[0-9]{{2}}{m}[0-9]{{2}}{m}[0-9]{{4}}" for m in ("[.]", "/", "-")]) + r")(?![0-9/-]|\.[0-9])"
_OTHER = "|".join([_EMAIL, _IPV4, _SSN, _DAY])
_SPACELESS = r"(?<![0-9-])[0-9](?:-?[0-9]){12,18}(?![0-9-])"
_CODE = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4})(?:[ .-]?[0-9]{2,4})"
#: 8 to 15 digits since the plus sign; written out, as a look-behind takes no repeated groups.
_ENOUGH = "(?<=" + "|".join(r"\+[0-9]" + "[ .()-]{0,2}[0-9]" * k for k in range(7, 15)) + ")(?![0-9])"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
_NUMBER = "[0-9]++(?:-[0-9]++)*+"
_HEX = "[0-9A-Fa-f]"
#: What stands before a secret; the cheap look-behind for its last character goes first.
_ASSIGNED = r"(?i:token|passwd|password|secret|apikey|api_key|api-key|access_key|auth_key)[\"']?\s?[=:]\s?"
_SECRET = "[A-Za-z0-9+/_=.-]"

#: What a candidate of each kind looks like, in order of precedence. A phone number ends before a value of another kind if it can; a card
#: candidate is a whole row of numbers (possessive, so that a long row needs no stack), in which _numbers() looks for the valid ones.
PATTERNS = {
    "email": _EMAIL,
    "secret": rf"(?<=[\"'])(?<={_ASSIGNED}[\"']){_SECRET}{{16,}}+(?=[\"'])"
    rf"|(?<=[=:\s])(?={_SECRET}{{16}})(?<={_ASSIGNED})(?=[A-Za-z+/_=.-]*+[0-9])(?=[0-9+/_=.-]*+[A-Za-z]){_SECRET}{{16,}}+"
    "|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ipv4": _IPV4,
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?={_HEX}*+:)(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}})(?![0-9A-Za-z:])",
    "phone": _CODE + "{1,4}?" + _ENOUGH + f"(?=[ .-](?:{_OTHER}|(?<![0-9-]){_CARD}(?![0-9-])))|" + _CODE + "{1,4}" + _ENOUGH + r"|(?<![0-9+(])\([2-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": _SSN,
    "date": _DAY,
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": f"(?<![0-9-])(?=[0-9](?:[ -]?[0-9]){{12}}){_NUMBER}(?: (?!{_OTHER}){_NUMBER})++-?+|{_SPACELESS}",
}
KINDS = list(PATTERNS)
#: All kinds in one alternation, one group each, in the order of KINDS.
PATTERN = "|".join(f"({p})" for p in PATTERNS.values())
#: Marks around and within a match while kinds are told; no kind's characters contain them.
_AROUND, _WITHIN, _NEITHER = "\x01", "\x02", "\x03"
#: Fixed value: country calling codes of one or two digits; all others have three.
_SHORT_CODES = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

_drawn: dict[str, str] = {}


def run_key(spark: SparkSession) -> str:
    """The key set in spark.alphaloom.pii.key, or one drawn for this application."""
    if key := spark.conf.get(KEY_CONF, None):
        return key
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _round(key: str, kind: str, r: Column, size: Column, value: Column) -> Column:
    """The keyed round function: 60 bits of a SHA-256."""
    told = F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), r.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """struct(l, r): the pair permuted within Z_a x Z_b. Odd rounds add to the left half what the keyed function makes of the right, even ones the reverse."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(x: Column, k: Column) -> Column:
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(x["l"] + _round(key, kind, k, a * 31 + b, x["r"]) % a, a)).otherwise(x["l"]).alias("l"),
            F.when(odd, x["r"]).otherwise(F.pmod(x["r"] + _round(key, kind, k, a * 31 + b, x["l"]) % b, b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _power(n: Column) -> Column:
    """10 to the power of n (up to 18) as an exact long."""
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _with(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A string of 1 to 36 digits permuted among the strings of its length."""
    n = F.length(d)
    k = F.floor(n / 2).cast("int")
    a, b = _power(n - k), _power(k)
    got = feistel(F.substring(d, F.lit(1), n - k).cast("long"), F.when(k > 0, F.substring(d, n - k + 1, k)).otherwise("0").cast("long"), a, b, key, kind)
    return _with(got, lambda x: F.concat(F.lpad(x["l"].cast("string"), n - k, "0"), F.when(k > 0, F.lpad(x["r"].cast("string"), k, "0")).otherwise("")))


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, one by one, by others."""
    at = lambda i: F.length(_digits(F.substring(form, F.lit(1), i))) + 1
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit that completes a string of digits."""
    n = F.length(body)

    def add(total: Column, j: Column) -> Column:
        d = F.substring(body, n - j + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(j % 2 == 1, twice).otherwise(d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = _with(_permuted_digits(body, key, "card"), lambda x: F.concat(x, _check_digit(x)))
    return F.when(_is_card(m), _with(new, lambda x: _refill(m, x)))


def _is_card(m: Column) -> Column:
    return m.rlike(f"^{_CARD}$") & F.call_function("luhn_check", _digits(m))


def _numbers(m: Column) -> Column:
    """A row of numbers as an array to be joined by spaces: from each number on the longest valid card, else the number alone."""

    def cut(parts: Column) -> Column:
        def card(i: Column) -> Column:
            """How many numbers from i on make the longest valid card; 0 for none."""
            to = F.sequence(F.least(i + 19, F.size(parts)) - i, F.lit(1))
            fit = F.filter(to, lambda k: _is_card(F.array_join(F.slice(parts, i + 1, k), " ")))
            return F.coalesce(F.get(fit, 0), F.lit(0)).alias("k")

        def step(a: Column, x: Column) -> Column:
            size = F.greatest(x["k"], F.lit(1))
            return F.when(x["i"] < a["next"], a).otherwise(F.struct((x["i"] + size).alias("next"), F.concat(a["out"], F.array(F.array_join(F.slice(parts, x["i"] + 1, size), " "))).alias("out")))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
        sizes = F.transform(parts, lambda _, i: F.struct(card(i), i.alias("i")))
        return _with(sizes, lambda n: F.when(F.exists(n, lambda x: x["k"] > 0), F.aggregate(n, start, step, lambda a: a["out"])).otherwise(F.array(m)))

    return _with(F.split(m, " "), cut)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    got = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")

    def show(x: Column) -> Column:
        k = F.floor(x["l"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", F.when(k >= 665, k + 2).otherwise(k + 1), (x["l"] % 99 + 1).cast("int"), (x["r"] + 1).cast("int"))

    return F.when(valid, _with(got, show))


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code permuted; a number in parentheses without one is as if it had the code 1."""

    def new(d: Column) -> Column:
        code = F.when(m.startswith("("), "").when(d.rlike(_SHORT_CODES), F.regexp_extract(d, _SHORT_CODES, 1)).otherwise(F.substring(d, 1, 3))
        return _with(code, lambda c: _with(_permuted_digits(F.substring(d, F.length(c) + 1, F.length(d)), key, "phone"), lambda x: _refill(m, F.concat(c, x))))

    return _with(_digits(m), lambda d: F.when((F.length(d) >= 8) & (F.length(d) <= 15), new(d)))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o))
    o = [F.get(octets, k).cast("long") for k in range(4)]
    got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ipv4")
    show = lambda x: F.concat_ws(".", *[(F.floor(x[h] / 256) if top else x[h] % 256).cast("long").cast("string") for h in "lr" for top in (True, False)])
    return F.when(valid, _with(got, show))


def _ipv6(m: Column, key: str) -> Column:
    """All 128 bits permuted in two halves of 64; valid are eight groups, or a single '::' that stands for the others (of which one has a digit)."""
    filled = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")
    halves = F.split(m, "::")
    head, tail = filled(F.get(halves, 0)), filled(F.coalesce(F.get(halves, 1), F.lit("")))
    n = F.size(head) + F.size(tail)
    short = F.size(halves) == 2
    valid = F.when(short, (n >= 2) & (n <= 7) & m.rlike("[0-9]") & ~m.rlike("(^:[^:])|([^:]:$)")).otherwise((F.size(halves) == 1) & (n == 8))
    groups = F.concat(head, F.array_repeat(F.lit("0"), F.when(short, 8 - n).otherwise(0)), tail)

    def bits(from_: int) -> Column:
        text = F.array_join(F.transform(F.slice(groups, from_, 4), lambda g: F.lpad(g, 4, "0")), "")
        return F.conv(text, 16, -10).cast("long")

    def step(x: Column, k: Column) -> Column:
        told = lambda v: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ipv6"), k.cast("string"), v.cast("string")), 256), 1, 16), 16, -10).cast("long")
        odd = k % 2 == 1
        return F.struct(F.when(odd, x["l"].bitwiseXOR(told(x["r"]))).otherwise(x["l"]).alias("l"), F.when(odd, x["r"]).otherwise(x["r"].bitwiseXOR(told(x["l"]))).alias("r"))

    def show(x: Column) -> Column:
        text = F.concat(*[F.lpad(F.lower(F.hex(x[k])), 16, "0") for k in "lr"])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(text, i * 4 + 1, F.lit(4))), ":")

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(bits(1).alias("l"), bits(5).alias("r")), step)
    return F.when(valid, _with(moved, show))


def _rest97(text: Column) -> Column:
    """A string of digits and capital letters (A is 10) as a number modulo 97."""
    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9A-Z]")), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """The longest start of m, up to the end of a word, that has a valid check number; its digits permuted, the check number computed anew."""
    body = lambda x: F.substring(x, F.lit(5), F.length(x))
    valid = lambda x: _rest97(F.concat(body(x), F.substring(x, 1, 4))) == 1
    ends = F.filter(F.sequence(F.length(m), F.lit(15), F.lit(-1)), lambda k: ~F.substring(m, k + 1, F.lit(1)).rlike("[A-Z0-9]") & ~F.substring(m, k, F.lit(1)).eqNullSafe(" "))
    end = F.when(F.length(m) >= 15, F.get(F.filter(ends, lambda k: valid(F.substring(m, F.lit(1), k))), 0))

    def new(x: Column) -> Column:
        d = _digits(body(x))
        moved = _with(_permuted_digits(d, key, "iban"), lambda y: _refill(body(x), y))
        check = lambda b: F.lpad((98 - _rest97(F.concat(b, F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.when(F.length(d) > 0, _with(moved, lambda b: F.concat(F.substring(x, 1, 2), check(b), b)))

    return _with(end, lambda k: F.when(k.isNotNull(), F.concat(new(F.substring(m, F.lit(1), k)), F.substring(m, k + 1, F.length(m)))))


def _date(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, "([./-])", 1)
    iso = m.rlike("^[0-9]{4}[-/]")
    day = lambda fmt, at: F.to_date(F.try_to_timestamp(F.concat_ws("-", *[F.substring(m, a, n) for a, n in at]), F.lit(fmt)))
    ymd = day("yyyy-MM-dd", ((1, 4), (6, 2), (9, 2)))
    mdy = day("yyyy-MM-dd", ((7, 4), (1, 2), (4, 2)))
    dmy = day("yyyy-MM-dd", ((7, 4), (4, 2), (1, 2)))
    month_first = ~iso & (mark == "/") & mdy.isNotNull()
    parsed = F.when(iso, ymd).when(month_first, mdy).otherwise(dmy)
    first = F.lit("1700-01-01").cast("date")

    def move(d: Column) -> Column:
        x = F.datediff(d, first).cast("long")
        got = feistel(F.floor(x / 773).cast("long"), x % 773, F.lit(189).cast("long"), F.lit(773).cast("long"), key, "date")
        new = _with(got, lambda y: F.date_add(first, (y["l"] * 773 + y["r"]).cast("int")))
        # With slashes the new day is always written month first, so that reading it again gives the same day.
        text = _with(new, lambda y: F.when(iso, F.date_format(y, "yyyy-MM-dd")).when(mark == "/", F.date_format(y, "MM-dd-yyyy")).otherwise(F.date_format(y, "dd-MM-yyyy")))
        return F.when((x >= 0) & (x < 146_097), F.replace(text, F.lit("-"), mark))

    return _with(parsed, lambda d: F.when(d.isNotNull(), move(d)))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    """Lower-case hexadecimal digits of a keyed digest, as many as the secret has characters."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64)), lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), k.cast("string"), m), 256))
    return F.substring(F.array_join(blocks, ""), F.lit(1), F.length(m))


_MAKERS = {"email": _email, "secret": _secret, "ipv4": _ipv4, "ipv6": _ipv6, "phone": _phone, "ssn": _ssn, "date": _date, "iban": _iban, "card": _card}


def _marked(text: Column) -> Column:
    """The text cut at its matches, in turn what stands between them and a match; a match is its groups, of which one isn't empty."""
    groups = _WITHIN.join(f"${k + 1}" for k in range(len(KINDS)))
    plain = F.translate(text, _AROUND + _WITHIN, _NEITHER * 2)
    return F.split(F.regexp_replace(plain, F.lit(PATTERN), F.lit(_AROUND + groups + _AROUND)), _AROUND, -1)


def candidates(marked: Column) -> Column:
    """array of array of struct(kind, raw): for every match in text order its candidates, which spaces join."""
    matches = F.filter(marked, lambda _, i: i % 2 == 1)
    names = F.array(*[F.lit(k) for k in KINDS])

    def told(groups: Column) -> Column:
        kind = F.get(names, (F.array_position(F.transform(groups, lambda x: x != ""), True) - 1).cast("int"))
        return F.struct(kind.alias("kind"), F.array_join(groups, "").alias("raw"))

    split = lambda m: F.when(m["kind"] == "card", _numbers(m["raw"])).otherwise(F.array(m["raw"]))
    return F.transform(F.transform(matches, lambda x: told(F.split(x, _WITHIN, -1))), lambda m: F.transform(split(m), lambda x: F.struct(m["kind"].alias("kind"), x.alias("raw"))))


def _replaced(found: Column, key: str) -> Column:
    """The candidates with new added, which is null where one isn't valid."""
    def one(x: Column) -> Column:
        new = F.when(F.lit(False), F.lit(None).cast("string"))
        for kind, make in _MAKERS.items():
            new = new.when(x["kind"] == kind, make(x["raw"], key))
        return F.struct(x["kind"].alias("kind"), x["raw"].alias("raw"), new.alias("new"))

    return F.transform(found, lambda m: F.transform(m, one))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """df with its texts pseudonymised under a secret key; found_col, if given, holds array of struct(kind, raw, new)."""
    if not key:
        raise ValueError("a key is needed")
    taken = set(df.columns)
    fresh = lambda name: next(n for n in (name + "_" * k for k in range(1, 99)) if n not in taken)
    found, rest, cut = found_col or fresh("found"), fresh("rest"), fresh("cut")
    t = F.col(f"`{text_col}`")
    hit = F.coalesce(t.rlike("[0-9@=:]|AKIA"), F.lit(False)) & t.rlike(PATTERN)
    none = F.array().cast("array<array<struct<kind:string,raw:string>>>")
    d = df.withColumn(cut, F.when(hit, _marked(t)))
    d = d.withColumn(found, F.when(F.col(cut).isNotNull(), candidates(F.col(cut))).otherwise(none)).withColumn(found, _replaced(F.col(found), key))
    # A text that holds the marks itself is cut once more; else what stands between the matches is known.
    between = F.when(t.rlike(f"[{_AROUND}{_WITHIN}]"), F.split(t, PATTERN, -1)).otherwise(F.filter(F.col(cut), lambda _, i: i % 2 == 0))
    d = d.withColumn(rest, F.when(F.size(found) > 0, between))
    parts = F.transform(found, lambda m, i: F.concat(F.get(F.col(rest), i), F.array_join(F.transform(m, lambda x: F.coalesce(x["new"], x["raw"])), " ")))
    d = d.withColumn(text_col, F.when(F.col(rest).isNull(), t).otherwise(F.concat(F.array_join(parts, ""), F.get(rest, F.size(found)))))
    return d.withColumn(found, F.flatten(found)).drop(rest, cut) if found_col else d.drop(rest, cut, found)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), run_key(spark), found_col="found")
    count = lambda kind: F.size(F.filter("found", lambda x: (x["kind"] == kind) & x["new"].isNotNull())).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", "text", *[count(k) for k in KINDS])
