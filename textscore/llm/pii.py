"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Entities are found by one regular expression.  Mentions are brought to a normal
form (digits of a number, lower-case e-mail address, one word of a name), and
each distinct entity gets a candidate drawn from SHA-256 of a secret key and the
entity: digits for digits and letters for letters in the same places, country
code, top-level domain, card network and Luhn status kept, names of the same
script and gender.  A candidate that another entity drew too, or that is itself
an entity of the corpus, is drawn anew (one entity keeps it), until all differ;
e-mail addresses, names and quoted secrets grow after some rounds, and what is
still open after ``MAX_ROUNDS`` gets a number in its surrogate, of a width that no
taken surrogate has; so different entities never share a surrogate and all
mentions of one entity get the same.  A secret of marks only (``******``) has
letters and digits drawn for its marks.  Only distinct mentions are joined, and
texts are joined once, by hash.

Everything runs on DataFrame functions.

Defined results: a null text stays null with no entities, an empty text stays
empty; rows that repeat are rewritten alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import free_name, written
from textscore.operators.ordering import md5_bucket, md5_digits_for, row_number_by

MAX_ROUNDS = 40
LONGER_EVERY = 3  # rounds after which candidates of free length grow

# Titles and given names by gender, and letters by script.
TITLES = "Mr|Mrs|Ms|Miss|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme|Господин|Госпожа"
GIVEN_NAMES = {
    "latin male": "James John Robert Michael David Thomas Peter Paul Carlos Miguel Pierre Hans Klaus Luis Antonio Jean",
    "latin female": "Mary Anna Maria Linda Susan Laura Julia Sofia Carmen Claire Marie Petra Elena Lucia Emma Sarah",
    "cyrillic male": "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Павел",
    "cyrillic female": "Мария Анна Елена Ольга Наталья Ирина Татьяна Светлана",
}
SYLLABLES = {  # consonants, vowels, endings
    "latin": ("b d f g h k l m n p r s t v w z".split(), "a e i o u".split(), "l n r s t m nd rt ck ll".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), "в к л м н р с т".split()),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ".split(), "α ε η ι ο".split(), "ς ν ρ".split()),
}
GENDERED_ENDINGS = "ская|ский|ова|ева|ина|ов|ев|ин|ая|ий|άκη|άκης|ου|ος"
PREFIXES = "AKIA|ghp_|gho_|ghu_|ghs_|ghr_|sk-"

# A surname goes to the end of the word: inner capitals, hyphens and apostrophes, but no 's or 'll.
_LETTERS = r"[\p{L}\p{M}]"
_START = r"\p{Lu}(?:\p{M}*+\p{Ll}|['’]\p{L})"
_SURNAME = rf"(?={_START})\p{{Lu}}{_LETTERS}*+(?:(?:['’](?!(?i:s|d|m|ll|re|ve)(?!\p{{L}}))|[-‐‑]){_LETTERS}++)*+"
_GIVEN = "|".join(n for names in GIVEN_NAMES.values() for n in names.split())
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey)[\"']?\s{0,3}[=:]\s{0,3}[\"'])[^\"'\s]{6,}+(?=[\"'])"
    r"|(?<![\p{L}\p{N}_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+|[0-9a-f]{32,}+)(?![\p{L}\p{N}_])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}-])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\p{L}\p{N}.])\d{13,19}(?![\p{L}\p{N}])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "given": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_GIVEN})(?!\p{{L}})(?:(?= {_START})|(?<=(?:{TITLES})\.? \p{{L}}{{1,20}}))",
    "name": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{TITLES})\.? ){_SURNAME}"
    rf"|(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}[\p{{L}}\p{{M}}'’‐‑-]{{1,40}} ){_SURNAME}"
    rf"|(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_GIVEN}) ){_SURNAME}",
}
# these start inside a word too: an address after a letter, a given name after a digit
INSIDE = ("ip", "given")
# no other entity does, which spares most places all further tries
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join(p for k, p in PATTERNS.items() if k not in INSIDE) + ")|" + "|".join(PATTERNS[k] for k in INSIDE)


# ------------------------------------------------------------ kinds and forms
def kind_of(mention: Column) -> Column:
    """Kind of a mention, from the mention alone."""
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    bare = ~mention.rlike(r"[^\d +().-]")
    return (
        F.when(mention.rlike(r"^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+$"), "email")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(bare & (digits >= 9) & mention.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(bare & digits.between(13, 19), "card")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?$"), "iban")
        .when(mention.rlike(rf"^({_GIVEN})$"), "given")
        .when(mention.rlike(rf"^{_SURNAME}$"), "name")
        .otherwise("secret")
    )


def normal_form(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share."""
    digits = F.regexp_replace(mention, r"\D", "")
    country = F.regexp_extract(mention, r"^\+(\d{1,3})[ .(-]", 1)
    phone = F.concat(country, F.lit(":"), F.substr(digits, F.length(country) + 1))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.translate(mention, "’‐‑", "'--"))
        .otherwise(mention)
    )


def render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format."""

    def refill(holes: str, filling: Column) -> Column:  # fillings one by one into the mention's places
        around = F.split(mention, holes, -1)
        return F.array_join(F.zip_with(around, F.split(filling, ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")

    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return (
        F.when(kind.isin("phone", "card", "ssn"), refill(r"\d", F.regexp_replace(surrogate, ":", "")))
        .when(kind == "iban", refill("[A-Z0-9]", surrogate))
        .when((kind == "email") & upper, F.upper(surrogate))
        .otherwise(surrogate)
    )


# ------------------------------------------------------------------ candidates
def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draws(key: str, kind: Column, form: Column, attempt: int) -> Column:
    """Four hex digits for each place of the form and some more, from SHA-256."""
    base = F.sha2(F.concat_ws("|", F.lit(key), kind, form, F.lit(str(attempt))).cast("binary"), 256)
    last = F.floor(F.length(form) / 16).cast("int") + 2
    return _bound(base, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.concat_ws("|", b, i.cast("string")).cast("binary"), 256)), ""))


def _pieces(draws: Column) -> Column:
    return F.regexp_extract_all(draws, F.lit(".{4}"), F.lit(0))


def _draw(stream: Column, i: Column | int, n: int) -> Column:
    return (F.conv(F.get(stream, F.lit(i) if isinstance(i, int) else i), 16, 10).cast("int") % n).cast("int")


def _letter(letters: list[str], stream: Column, i: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, letters)), _draw(stream, i, len(letters)) + 1)


def _same_classes(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Digits for digits, letters for letters of the same case; the rest stays."""
    lower, six = [chr(c) for c in range(97, 123)], list("abcdef")

    def one(c: Column, i: Column, stream: Column, hexadecimal: Column) -> Column:
        letter = F.when(hexadecimal, _letter(six, stream, i)).otherwise(_letter(lower, stream, i))
        return (
            F.when(c.rlike("^[0-9]$"), _draw(stream, i, 10).cast("string"))
            .when(c.rlike(r"^\p{Ll}$"), letter)
            .when(c.rlike(r"^\p{L}$"), F.upper(letter))
            .otherwise(c)
        )

    def all_of(st: Column) -> Column:
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, st["stream"], st["hexadecimal"])), "")

    return _bound(F.struct(stream.alias("stream"), hexadecimal.alias("hexadecimal")), all_of)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number; 0 modulo 10 for a valid one."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _card(form: Column, stream: Column, number: Column | None = None) -> Column:
    body = F.concat(F.substr(form, F.lit(1), F.lit(1)), _same_classes(F.substr(form, F.lit(2), F.length(form) - 2), stream, F.lit(False)))
    body = body if number is None else F.concat(body, number)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    other = (check + 1 + _draw(stream, F.length(form), 9)) % 10  # any digit but the right one
    return F.concat(body, F.when(_luhn_sum(form) % 10 == 0, check).otherwise(other).cast("string"))


def _name(form: Column, stream: Column, attempt: int) -> Column:
    def made(script: str) -> Column:
        consonants, vowels, endings = SYLLABLES[script]
        ending = F.regexp_extract(form, f"({GENDERED_ENDINGS})$", 1)
        parts = F.greatest(F.lit(2), F.round(F.length(form) / 3).cast("int")) + attempt // LONGER_EVERY
        body = F.array_join(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.concat(_letter(consonants, stream, i * 2), _letter(vowels, stream, i * 2 + 1))), "")
        return F.initcap(F.concat(body, F.when(ending != "", F.concat(_letter(consonants, stream, F.length(form) + 3), ending)).otherwise(_letter(endings, stream, F.length(form) + 3))))

    return F.when(form.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(form.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def candidate(key: str, kind: Column, form: Column, attempt: int) -> Column:
    """The surrogate that an entity draws at an attempt."""
    return _bound(_draws(key, kind, form, attempt), lambda draws: _bound(_pieces(draws), lambda stream: _drawn(kind, form, attempt, draws, stream)))


def _drawn(kind: Column, form: Column, attempt: int, draws: Column, stream: Column) -> Column:
    no = F.lit(False)
    more = F.substr(draws, F.lit(4 * 40 + 1), F.lit(attempt // LONGER_EVERY)) if attempt >= LONGER_EVERY else F.lit("")
    more = F.translate(more, "0123456789", "ghijklmnop")
    top = F.regexp_extract(form, r"(\.[^.]*)$", 1)
    at = F.instr(form, "@")
    local = F.concat(_same_classes(F.substr(form, F.lit(1), at - 1), stream, no), more)
    domain = _same_classes(F.substr(form, at, F.length(form) - at - F.length(top) + 1), _pieces(F.reverse(draws)), no)
    code = F.regexp_extract(form, "^([0-9]*:)", 1)
    octet = lambda i: (_draw(stream, i, 254) + 1).cast("string")
    prefix = F.regexp_extract(form, f"^({PREFIXES})", 1)
    rest = F.substr(form, F.length(prefix) + 1)
    # marks alone have nothing to redraw: their places are filled
    filled = F.array_join(F.transform(F.split(rest, ""), lambda c, i: F.when(c != "", _letter(list("abcdefghijklmnopqrstuvwxyz0123456789"), stream, i)).otherwise("")), "")
    redrawn = F.when(rest.rlike(r"[0-9\p{L}]"), _same_classes(rest, stream, rest.rlike("^[0-9a-f]+$"))).otherwise(filled)
    return (
        F.when(kind == "email", F.concat(local, domain, top))
        .when(kind == "phone", F.concat(code, _same_classes(F.substr(form, F.length(code) + 1), stream, no)))
        .when(kind == "card", _card(form, stream))
        .when(kind == "ssn", _same_classes(form, stream, no))
        .when(kind == "ip", F.concat_ws(".", *(octet(i) for i in range(4))))
        .when(kind == "iban", F.concat(F.substr(form, F.lit(1), F.lit(2)), _same_classes(F.substr(form, F.lit(3)), stream, no)))
        .when(kind == "name", _name(form, stream, attempt))
        .otherwise(F.concat(prefix, redrawn, F.when(prefix == "", more).otherwise("")))
    )


def numbered(key: str, kind: Column, form: Column, number: Column) -> Column:
    """The surrogate with a number in it; with numbers of one width no two are alike."""
    last = candidate(key, kind, form, MAX_ROUNDS)
    letters = [F.translate(number, "0123456789", to) for to in ("abcdefghij", "абвгдежзик", "αβγδεζηθικ")]
    letter = F.when(form.rlike(r"\p{IsCyrillic}"), letters[1]).when(form.rlike(r"\p{IsGreek}"), letters[2]).otherwise(letters[0])
    return (
        F.when(kind == "email", F.concat(F.substring_index(last, "@", 1), number, F.lit("@"), F.substring_index(last, "@", -1)))
        .when(kind == "card", _card(form, _pieces(_draws(key, kind, form, MAX_ROUNDS)), number))
        .when(kind == "ip", F.concat(last, F.lit("."), number))
        .when(kind == "name", F.concat(last, letter))
        .otherwise(F.concat(last, number))
    )


def given_names(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next of its gender and script in keyed order."""
    out = {}
    for names in GIVEN_NAMES.values():
        ring = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).hexdigest())
        out |= {n: ring[(i + 1) % len(ring)] for i, n in enumerate(ring)}
    return out


# ------------------------------------------------------------------ assignment
def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, form, surrogate)`` for distinct ``entities(kind, form)``; no two
    entities of a kind share a surrogate and none is an entity itself."""
    names = F.create_map(*(F.lit(x) for pair in given_names(key).items() for x in pair))
    given = entities.where(F.col("kind") == "given").withColumn("surrogate", F.element_at(names, F.col("form")))
    open_ones, done = entities.where(F.col("kind") != "given"), []
    originals = entities.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
    for attempt in range(MAX_ROUNDS):
        drawn = open_ones.withColumn("surrogate", candidate(key, F.col("kind"), F.col("form"), attempt))
        # who draws a surrogate first in the order of forms keeps it
        firsts = drawn.groupBy("kind", "surrogate").agg(F.min("form").alias("first"))
        taken = originals
        for d in done:
            taken = taken.union(d.select("kind", "surrogate", F.lit(True).alias("real")))
        free = firsts.join(taken, ["kind", "surrogate"], "left_anti").withColumnRenamed("first", "form")
        got = drawn.join(free.withColumn("kept", F.lit(True)), ["kind", "form", "surrogate"], "left")
        got = written(got, "surrogates")
        done.append(got.where("kept").select("kind", "form", "surrogate"))
        open_ones = got.where("kept is null").select("kind", "form")
        if open_ones.isEmpty():
            out = given.select("kind", "form", "surrogate")
            for d in done:
                out = out.union(d)
            return out
    order = F.md5(F.concat_ws("|", F.lit(key), "kind", "form").cast("binary"))
    rest = row_number_by(open_ones.withColumn("_h", order), ["_h", "kind", "form"], bucket=md5_bucket(F.col("_h"), md5_digits_for(open_ones)), out_col="_n")
    rest = written(rest.select("kind", "form", F.col("_n").cast("string").alias("_n")), "surrogates")
    taken = originals
    for d in done:
        taken = taken.union(d.select("kind", "surrogate", F.lit(True).alias("real")))
    width = rest.agg(F.max(F.length("_n"))).first()[0]
    while True:  # ends: a width is reached at last that makes them longer than all that are taken
        told = rest.select("kind", "form", numbered(key, F.col("kind"), F.col("form"), F.lpad("_n", width, "0")).alias("surrogate"))
        if told.join(taken, ["kind", "surrogate"], "left_semi").isEmpty():
            break
        width += 1
    out = given.select("kind", "form", "surrogate").union(told)
    for d in done:
        out = out.union(d)
    return out


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """``docs`` with every entity in the text replaced, and the number of entities."""
    text = F.col(text_col)
    place = lambda c: F.sha2(c.cast("binary"), 256)
    found = docs.select(place(text).alias("_k"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found"))
    # copies of a text count once
    found = written(found.where(F.size("found") > 0).groupBy("_k", "found").agg(F.count(F.lit(1)).alias("texts")), "entities")
    mentions = found.select("_k", F.posexplode("found").alias("pos", "mention"))
    kinds = mentions.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    kinds = written(kinds.withColumn("form", normal_form(F.col("kind"), F.col("mention"))), "mentions")
    surrogates = assign_surrogates(kinds.select("kind", "form").distinct(), key)
    told = kinds.join(surrogates, ["kind", "form"]).select("mention", render(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"))
    k, new = free_name(docs, "_k"), free_name(docs, "_new")
    # every mention is told; left, since many mentions of few entities make a small file but a large broadcast
    places = mentions.join(told, "mention", "left").groupBy(F.col("_k").alias(k)).agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias(new))
    joined = docs.withColumn(k, place(text)).join(places, k, "left")
    pieces = F.zip_with(F.split(text, ENTITY, -1), F.col(f"{new}.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    columns = {text_col: F.when(F.col(new).isNull(), text).otherwise(F.array_join(pieces, ""))}
    if count_col:
        columns[count_col] = F.when(F.col(new).isNull(), 0).otherwise(F.size(new))
    return joined.withColumns(columns).select(*docs.columns, *([count_col] if count_col and count_col not in docs.columns else []))
