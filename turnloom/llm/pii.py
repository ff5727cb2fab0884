"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are replaced by others of the same format under a key: card numbers (Luhn), IBANs (mod 97), North
American and other international phone numbers, US social security numbers, IPv4 addresses, dates of 1900-2099 and the
local part of mail addresses. Equal values get equal pseudonyms everywhere, so they stay linked across documents;
separators, country codes and mail domains stay; check digits are computed anew. Values that fail validation stay.

A number is split as (left, right) with left < a and right < b; each round adds a keyed SHA-256 value of the other half
to a half, modulo a or b. That is a permutation of exactly a * b numbers, so no value leaves its format and none is
looked up in a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: Characters of an IBAN by country.
IBAN_SIZES = dict(
    zip(*[iter("AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BI 27 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DJ 27 DK 18 DO 28 EE 20 EG 29 ES 24 FI 18 FK 18 FO 18 FR 27 GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HN 28 HR 21 HU 28 IE 22 IL 23 IQ 23 IS 26 IT 27 JO 30 KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20 LU 20 LV 21 LY 25 MC 27 MD 24 ME 22 MK 19 MN 20 MR 27 MT 31 MU 30 NI 28 NL 18 NO 15 OM 23 PK 24 PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 RU 33 SA 24 SC 31 SD 18 SE 24 SI 19 SK 24 SM 27 SO 23 ST 25 SV 28 TL 23 TN 24 TR 26 UA 29 VA 22 VG 24 XK 20 YE 30".split())] * 2)
)
#: Digits after the country code where that number is fixed; a trunk 0 in parentheses may come before them.
PHONE_SIZES = {7: 10, 31: 9, 33: 9, 34: 9, 41: 9, 44: 10, 45: 8, 47: 8, 48: 9, 61: 9, 91: 10}


def _iban_form() -> str:
    """The country's own length first, the general form for what has another one."""
    sizes: dict[int, list[str]] = {}
    for country, size in IBAN_SIZES.items():
        sizes.setdefault(int(size), []).append(country)
    own = [f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in sorted(sizes.items())]
    return f"(?:{'|'.join(own)})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?(?!{OTHER})[A-Z0-9]{{4}}){{2,7}}(?: ?(?!{OTHER})[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"


#: What a match can be, in this order at any place of a text. Groups that repeat without a bound are possessive: they are
#: matched in a loop, where a greedy group would take a level of the stack per repeat.
MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)++"
LOCAL_PHONE = r"\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9])|[2-9][0-9]{2}[.\-][2-9][0-9]{2}[.\-][0-9]{4}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
IPV4 = r"(?<![A-Za-z])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4}(?!-)|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"
PLAIN = r"(?<![0-9.+\-])(?:" + "|".join((LOCAL_PHONE, SSN, IPV4, DATE)) + ")"
NOT_MAIL = r"(?<![A-Za-z0-9._%+\-@])"
#: Starts of other values, at which a run of numbers ends.
OTHER = f"{PLAIN}|{NOT_MAIL}{MAIL}"
#: Numbers apart by one blank or hyphen each; ``_cards`` looks for the cards among them.
TAIL = f"(?:[ \\-](?!{OTHER})[0-9]++)*+"
RUN = r"(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++" + TAIL
#: Usual groups of card numbers as lengths, and how many numbers each has, in the order in which they are tried.
CARD_GROUPS = {4: "4-4-4-4", 3: "4-6-[45]", 1: "1[3-9]", 5: "4-4-4-4-[1-3]"}
CARD = r"[0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9])|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}(?![0-9])|[0-9]{13,19}(?![0-9])"
IBAN = _iban_form()
_FIXED = [r"1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"] + [f"{c}[ .\\-]?(?:\\(0\\)[ .\\-]?)?\\(?[0-9]\\)?(?:[ .\\-]?\\(?[0-9]\\)?){{{n - 1}}}" for c, n in PHONE_SIZES.items()]
PHONE = rf"\+(?!{CARD})(?:(?:{'|'.join(_FIXED)})(?![0-9])|[0-9]{{1,3}}(?:[ .\-]?(?!(?<= )(?:{CARD}|{DATE}))\(?[0-9]{{1,5}}\)?){{2,6}}(?![0-9]))"
#: As much of a longer general phone match as a phone number can have.
PHONE_HEAD = r"^\+[0-9](?:[ .\-]?\(?[0-9]\)?){7,14}(?![0-9])"
VALUE = f"{NOT_MAIL}(?:{MAIL}|(?:{IBAN}){TAIL})|(?:{PHONE})|{PLAIN}|(?<![0-9])(?:{RUN})"
#: Shares of a value's digits or letters that are permuted at once.
BLOCK = 18


def _feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """Struct (left, right) after the rounds, written as one fold so each half is computed once."""

    def step(state: Column, i: Column) -> Column:
        def noise(half: Column, most: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), tweak, half.cast("string")), 256)
            return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), most)

        even = F.pmod(i, F.lit(2)) == 0
        l2 = F.when(even, F.pmod(state["l"] + noise(state["r"], a), a)).otherwise(state["l"])
        r2 = F.when(even, state["r"]).otherwise(F.pmod(state["r"] + noise(state["l"], b), b))
        return F.struct(l2.alias("l"), r2.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permuted(text: Column, base: int, tweak: str, key: str) -> Column:
    """A string of digits of ``base`` (10 or 36, lower case) permuted among those of its length, block by block."""

    def block(k: Column) -> Column:
        part = F.substring(text, k * BLOCK + 1, F.lit(BLOCK))

        def halves(p: Column) -> Column:
            n = F.length(p)
            n1 = (n / 2).cast("int")
            value = (lambda s: s.cast("bigint")) if base == 10 else (lambda s: F.conv(s, 36, 10).cast("bigint"))
            size = lambda m: F.pow(F.lit(float(base)), m).cast("bigint")
            left = F.when(n1 == 0, F.lit(0)).otherwise(value(F.substring(p, F.lit(1), F.greatest(n1, F.lit(1)))))
            mixed = _feistel(left, value(F.substring(p, n1 + 1, n - n1)), size(n1), size(n - n1), F.concat_ws(":", F.lit(tweak), F.length(text).cast("string"), k.cast("string")), key)

            def written(m: Column) -> Column:
                show = (lambda v: v.cast("string")) if base == 10 else (lambda v: F.lower(F.conv(v.cast("string"), 10, 36)))
                return F.concat(F.when(n1 == 0, F.lit("")).otherwise(F.lpad(show(m["l"]), n1, "0")), F.lpad(show(m["r"]), n - n1, "0"))

            return _bound(mixed, written)

        return _bound(part, halves)

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / BLOCK).cast("int") - 1), block)
    return F.when(F.length(text) == 0, text).otherwise(F.array_join(blocks, ""))


def _refilled(shape: Column, filling: Column, pattern: str) -> Column:
    """``shape`` with its characters that match ``pattern`` replaced one by one by those of ``filling``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))

    def step(state: Column, c: Column) -> Column:
        hit = c.rlike(pattern)
        return F.struct((state["i"] + hit.cast("int")).alias("i"), F.concat(state["s"], F.when(hit, F.substring(filling, state["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(chars, start, step, lambda s: s["s"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN-like string (letters count 10 to 35)."""
    def step(s: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return F.pmod(F.when(v > 9, s * 100).otherwise(s * 10) + v, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        def checked(body: Column) -> Column:
            digit = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
            return _refilled(m, F.concat(body, digit.cast("string")), "[0-9]")

        return F.when(F.pmod(_luhn(d), F.lit(10)) == 0, _bound(_permuted(F.substring(d, F.lit(1), F.length(d) - 1), 10, "card", key), checked)).otherwise(m)

    return _bound(_digits(m), replaced)


def _cards(m: Column, key: str) -> Column:
    """Array of (old, new) pieces of a run of numbers: valid cards between what stays.

    At every number the usual groups are tried; where none of them is valid in the whole run, every length of 13 to 19
    digits from its first number on, longest first.
    """

    def of(s: Column) -> Column:
        words, gaps, n = s["words"], s["gaps"], F.size(s["words"])

        def digits(i: Column, k: Column) -> Column:
            return F.array_join(F.slice(words, i, k), "")

        def apart(i: Column, k: Column) -> Column:
            return (i + k - 1 <= n) & F.forall(F.slice(gaps, i + 1, k - 1), lambda g: g.isin(" ", "-"))

        def valid(i: Column, k: Column) -> Column:
            return _bound(digits(i, k), lambda d: F.length(d).between(13, 19) & (F.pmod(_luhn(d), F.lit(10)) == 0))

        def usual(i: Column) -> Column:
            def shaped(k: Column) -> Column:
                sizes = F.array_join(F.transform(F.slice(words, i, k), lambda w: F.length(w).cast("string")), "-")
                return apart(i, k) & sizes.rlike("^(?:" + "|".join(CARD_GROUPS.values()) + ")$") & valid(i, k)

            return F.get(F.filter(F.array(*[F.lit(k) for k in CARD_GROUPS]), shaped), F.lit(0))

        span = lambda i, k: F.struct(i.cast("int").alias("i"), k.cast("int").alias("k"))
        places = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: span(i, usual(i))), lambda h: h["k"].isNotNull())
        longest = F.get(F.filter(F.sequence(F.least(n, F.lit(19)), F.lit(1), F.lit(-1)), lambda k: apart(F.lit(1), k) & valid(F.lit(1), k)), F.lit(0))

        def chosen(hits: Column) -> Column:
            whole = F.when(longest.isNotNull(), F.array(span(F.lit(1), longest))).otherwise(F.filter(hits, lambda _: F.lit(False)))

            # Earlier cards first; one that overlaps a chosen one is left out.
            def step(a: Column, h: Column) -> Column:
                last = F.get(a, F.size(a) - 1)
                return F.when((F.size(a) == 0) | (h["i"] >= last["i"] + last["k"]), F.concat(a, F.array(h))).otherwise(a)

            return F.when(F.size(hits) > 0, F.aggregate(hits, F.filter(hits, lambda _: F.lit(False)), step)).otherwise(whole)

        def text(i: Column, k: Column) -> Column:
            """Numbers i to i + k - 1 with the gaps between them."""
            return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), F.slice(gaps, i + 1, k - 1)), F.slice(words, i, k), lambda g, w: F.concat(g, w)), "")

        def around(a: Column, b: Column) -> Column:
            """What lies between number a and number b, both left out; the ends of the run at 0 and n + 1."""
            return F.concat(F.get(gaps, a), F.when(b - a > 1, F.concat(text(a + 1, b - a - 1), F.get(gaps, b - 1))).otherwise(""))

        def pieces(cards: Column) -> Column:
            def piece(h: Column, j: Column) -> Column:
                before = F.when(j == 0, F.lit(0)).otherwise(F.get(cards, j - 1)["i"] + F.get(cards, j - 1)["k"] - 1)
                stay, old = around(before, h["i"]), text(h["i"], h["k"])
                return F.array(_bound(stay, _same), _bound(old, lambda o: F.struct(o.alias("old"), _card(o, key).alias("new"))))

            last = F.get(cards, F.size(cards) - 1)
            return F.when(F.size(cards) > 0, F.concat(F.flatten(F.transform(cards, piece)), F.array(_bound(around(last["i"] + last["k"] - 1, n + 1), _same))))

        return _bound(_bound(places, chosen), pieces)

    parts = F.struct(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)).alias("words"), F.split(m, "[0-9]+", -1).alias("gaps"))
    return F.coalesce(F.when(F.length(_digits(m)) >= 13, _bound(parts, of)), F.array(_same(m)))


def _same(m: Column) -> Column:
    return F.struct(m.alias("old"), m.alias("new"))


def _iban(m: Column, key: str) -> Column:
    def replaced(s: Column) -> Column:
        country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s) - 4)
        valid = _mod97(F.concat(body, F.substring(s, 1, 4))) == 1
        fresh = _refilled(body, _permuted(_digits(body), 10, "iban", key), "[0-9]")

        def checked(b: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return _refilled(m, F.concat(country, check, b), "[A-Z0-9]")

        return F.when(valid, _bound(fresh, checked)).otherwise(m)

    return _bound(F.regexp_replace(m, " ", ""), replaced)


def _phone(m: Column, key: str) -> Column:
    """North American numbers stay within their kind (area and exchange of 200-999, or not); others keep two digits."""

    def replaced(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        american = (F.length(d) == 10) & ~m.startswith("+") | (F.length(d) == 11) & m.startswith("+1")
        # Three classes that keep to themselves: valid, an exchange below 200, an area below 200.
        area, exchange, line = F.substring(ten, 1, 3).cast("bigint"), F.substring(ten, 4, 3).cast("bigint"), F.substring(ten, 7, 4).cast("bigint")
        low_area, low_exchange = area < 200, exchange < 200
        left = F.when(low_area, area * 1000 + exchange).when(low_exchange, (area - 200) * 200 + exchange).otherwise((area - 200) * 800 + exchange - 200)
        most = F.when(low_area, F.lit(200000)).when(low_exchange, F.lit(160000)).otherwise(F.lit(640000)).cast("bigint")
        pair = _feistel(left, line, most, F.lit(10000).cast("bigint"), F.concat(F.lit("nanp"), most.cast("string")), key)

        def written(p: Column) -> Column:
            x = p["l"]
            head = F.when(low_area, F.lpad(x.cast("string"), 6, "0")).when(low_exchange, F.concat(((x / 200).cast("bigint") + 200).cast("string"), F.lpad(F.pmod(x, F.lit(200)).cast("string"), 3, "0")))
            head = head.otherwise(F.concat(((x / 800).cast("bigint") + 200).cast("string"), (F.pmod(x, F.lit(800)) + 200).cast("string")))
            return _refilled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), head, F.lpad(p["r"].cast("string"), 4, "0")), "[0-9]")

        other = m.startswith("+") & F.length(d).between(8, 15) & ~american
        return F.when(american, _bound(pair, written)).when(other, _refilled(m, F.concat(F.substring(d, 1, 2), _permuted(F.substring(d, F.lit(3), F.length(d) - 2), 10, "phone", key)), "[0-9]")).otherwise(m)

    return _bound(_digits(m), replaced)


def _ssn(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        area, group, serial = F.substring(d, 1, 3).cast("bigint"), F.substring(d, 4, 2).cast("bigint"), F.substring(d, 6, 4).cast("bigint")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        left = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1
        pair = _feistel(left, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), F.lit("ssn"), key)

        def written(p: Column) -> Column:
            index = (p["l"] / 99).cast("bigint") + 1
            return F.concat_ws("-", F.lpad(F.when(index >= 666, index + 1).otherwise(index).cast("string"), 3, "0"), F.lpad((F.pmod(p["l"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, _bound(pair, written)).otherwise(m)

    return _bound(_digits(m), replaced)


def _ipv4(m: Column, key: str) -> Column:
    def replaced(o: Column) -> Column:
        n = [o[i].cast("bigint") for i in range(4)]
        valid = F.greatest(*n) <= 255
        pair = _feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), F.lit("ipv4"), key)
        part = lambda x: F.concat_ws(".", (x / 256).cast("bigint").cast("string"), F.pmod(x, F.lit(256)).cast("string"))
        return F.when(valid, _bound(pair, lambda p: F.concat_ws(".", part(p["l"]), part(p["r"])))).otherwise(m)

    return _bound(F.split(m, r"\."), replaced)


def _date(m: Column, key: str) -> Column:
    """Days since 1900 are permuted within the first 73,000 and within the last 49. d/m and m/d: whichever is valid."""
    parts = F.split(m, r"[\-/.]")
    iso = m.rlike("^[0-9]{4}[-/]")

    def replaced(p: Column) -> Column:
        year = F.when(iso, p[0]).otherwise(p[2])
        one, two = F.lpad(F.when(iso, p[1]).otherwise(p[0]), 2, "0"), F.lpad(F.when(iso, p[2]).otherwise(p[1]), 2, "0")
        month_first = F.coalesce(F.try_to_timestamp(F.concat_ws("-", year, one, two), F.lit("yyyy-MM-dd")).cast("date"), F.lit(None).cast("date"))
        day_first = F.try_to_timestamp(F.concat_ws("-", year, two, one), F.lit("yyyy-MM-dd")).cast("date")
        swap = ~iso & day_first.isNotNull()
        day = F.when(swap, day_first).otherwise(month_first)
        index = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("bigint")

        def written(i: Column) -> Column:
            late = i >= 73000
            rest = F.when(late, i - 73000).otherwise(i)
            a, b = F.when(late, F.lit(7)).otherwise(F.lit(250)).cast("bigint"), F.when(late, F.lit(7)).otherwise(F.lit(292)).cast("bigint")
            pair = _feistel((rest / b).cast("bigint"), F.pmod(rest, b), a, b, F.concat(F.lit("date"), late.cast("string")), key)

            def shown(q: Column) -> Column:
                new = F.date_add(F.lit("1900-01-01").cast("date"), (q["l"] * b + q["r"] + F.when(late, F.lit(73000)).otherwise(F.lit(0))).cast("int"))
                sep = F.regexp_extract(m, r"[\-/.]", 0)
                ends = F.when(swap, F.date_format(new, "dd|MM|yyyy")).otherwise(F.date_format(new, "MM|dd|yyyy"))
                return F.replace(F.when(iso, F.date_format(new, "yyyy|MM|dd")).otherwise(ends), F.lit("|"), sep)

            return _bound(pair, shown)

        return F.when(day.isNotNull() & index.between(0, 73048), _bound(index, written)).otherwise(m)

    return _bound(parts, replaced)


def _mail(m: Column, key: str) -> Column:
    """The letters and digits of the local part as one number of base 36, whatever their case; capitals stay in their places."""
    local = F.substring_index(m, "@", 1)
    fresh = _refilled(F.lower(local), _permuted(F.regexp_replace(F.lower(local), "[^0-9a-z]", ""), 36, "mail", key), "[0-9a-z]")
    cased = F.array_join(F.zip_with(F.split(local, ""), F.split(fresh, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    return F.concat(F.when(local.rlike("[A-Z]"), cased).otherwise(fresh), F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match of ``VALUE`` as an array of (old, new) pieces; equal where a piece is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    one = lambda fresh: F.array(F.struct(m.alias("old"), fresh.alias("new")))

    def headed(head: Column, new: Column) -> Column:
        """A value at the start of the match and the numbers after it."""
        rest = F.substring(m, F.length(head) + 1, F.length(m))
        return F.concat(F.array(F.struct(head.alias("old"), new.alias("new"))), F.when(rest == "", F.array().cast("array<struct<old:string,new:string>>")).otherwise(_bound(rest, lambda r: _cards(r, key))))

    def iban(head: Column) -> Column:
        return _bound(_iban(head, key), lambda new: F.when(new != head, headed(head, new)).otherwise(_cards(m, key)))

    def phone(head: Column) -> Column:
        return F.when(head == "", _cards(m, key)).otherwise(headed(head, _phone(head, key)))

    long_phone = m.startswith("+") & (F.length(_digits(m)) > 15)
    return (
        F.when(m.contains("@"), one(_mail(m, key))).when(m.rlike("^[A-Z]"), _bound(F.regexp_extract(m, f"^(?:{IBAN})", 0), iban))
        .when(long_phone, _bound(F.regexp_extract(m, PHONE_HEAD, 0), phone)).when(m.startswith("+") | whole(LOCAL_PHONE), one(_phone(m, key))).when(whole(SSN), one(_ssn(m, key)))
        .when(whole(IPV4), one(_ipv4(m, key))).when(whole(DATE), one(_date(m, key))).otherwise(_cards(m, key))
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced; ``count_col``, if given, counts those that changed.

    A text is cut at its matches and put together again, so whole texts of any length are handled in one pass over the
    rows, without a shuffle. Null stays null (count 0); a text without a valid value stays as it is. Repeated rows get equal
    results; an empty table stays empty.
    """
    text = F.col(f"`{text_col}`")
    found = "__found"
    while found in docs.columns:
        found += "_"
    matches = F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(VALUE), F.lit(0)))
    fresh = F.transform(matches, lambda m: pseudonym(m, key))
    rows = docs.withColumn(found, F.when(F.size(matches) > 0, fresh))
    value = F.col(found)
    between = F.split(text, VALUE, -1)
    joined = F.array_join(F.zip_with(between, F.concat(F.transform(value, lambda v: F.array_join(v["new"], "")), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = {text_col: F.when(value.isNull(), text).otherwise(joined)}
    if count_col:
        out[count_col] = F.coalesce(F.size(F.filter(F.flatten(value), lambda v: v["old"] != v["new"])), F.lit(0)).cast("long")
    return rows.withColumns(out).drop(found)
