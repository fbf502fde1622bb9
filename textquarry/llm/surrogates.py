"""Personal data replaced by keyed, type-consistent surrogates, with DataFrame functions only.

One regular expression finds e-mail addresses, IBANs, IPv4 addresses, payment cards, social security
numbers, telephone numbers and names behind a form of address. Each entity has a canonical form
(lower case, or its digits). A keyed SHA-256 of kind, canonical form and attempt drives the
replacement of that form: letters by letters of the same script, digits by digits, octets by octets, card
numbers with a valid check digit where the original has one, given names by names of the gender
that the form of address tells, surnames by themselves, so that all who bear one keep sharing it. Dr and
Prof tell no gender: there a given name of the lists below does, and others get a neutral one. The result is then put back into the original's layout: separators,
brackets, country code, capitals. Equal entities, in whatever layout, get equal surrogates everywhere.

Distinct entities must stay distinct, and no surrogate may be another real entity. All distinct
canonical forms are gathered (never texts), surrogates that meet or that equal a real form are found by
an aggregation and a join, and those entities try again with the next attempt until none is left. The
few entities with an attempt above 0 are joined to the documents that mention them; usually there are
none, and the text is rewritten in place without a shuffle. Where a kind has nearly as many entities as surrogates of
their length (one-letter addresses, four-digit numbers), those that still meet after GROW_AFTER attempts get longer ones.

Defined results
    null text stays null, texts without entities stay as they are, byte for byte. Null and repeated ids
    are irrelevant: rows are rewritten independently. Empty table: no rows. All other columns are
    returned untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.sources.shared import written

#: Forms of address and the gender they tell; letters by script; names and name syllables.
_FEMALE = r"Mrs|Ms|Miss|Mme|Mlle|Frau|Sra|Señora|Doña|Г-жа|г-жа"
_MALE = r"Mr|Herr|Sr|Señor|Г-н|г-н"
_TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{_FEMALE}|{_MALE}|Dr|Prof)\.?\x20"
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
_LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[0-9]": "0123456789",
    r"\p{IsLatin}": "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþœ",
    r"\p{IsCyrillic}": "абвгдежзийклмнопрстуфхцчшщыьэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    r"\p{IsHan}": "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHangul}": "김이박최정강조윤장임한오서신권황안송전홍",
    r"\p{N}": "0123456789",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
_GIVEN = {
    ("f", "latin"): "anna clara diana elena flora helen irene julia laura maria nora olivia paula rosa sofia vera",
    ("m", "latin"): "adam bruno carl david edwin felix georg henry ivan jakob lukas martin oscar paul robert victor",
    ("n", "latin"): "alex andrea chris dominique eli jamie jules kim lou luca micha noa quinn robin sascha toni",
    ("f", "cyrillic"): "анна вера галина дарья елена ирина лидия мария нина ольга полина раиса софия тамара ульяна юлия",
    ("m", "cyrillic"): "антон борис виктор глеб денис егор захар иван кирилл лев максим никита олег павел роман сергей",
    ("n", "cyrillic"): "валя женя саша шура",
}
_SYLLABLES = {
    "latin": "bal ber cor dal den fer gar hol jan kel lor mar nes pol ran sel tor ul ver wil",
    "cyrillic": "бал бер вол гор дал дим кар лен мар нов ор пет рад сав тар ул фед хол чер яр",
}

#: Attempts after which surrogates grow longer than their originals.
GROW_AFTER = 12

_PART = r"[\p{L}\p{N}._%+-]"
_LABEL = r"[\p{L}\p{N}-]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<!{_PART}){_PART}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "name": _TITLED + r"\p{Lu}[\p{L}'’-]+(?:\x20\p{Lu}[\p{L}'’-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap: texts without these have no entity.
_MAYBE = rf"@|[0-9][0-9().\x20-]{{5}}|[A-Z]{{2}}[0-9]{{2}}|{_TITLED}"


# ---- entity -> kind, canonical form ------------------------------------------------------------------


def kind_of(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"), "iban")
        .when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(e.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"), "card")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def _country(e: Column) -> Column:
    """The country code of a telephone number, kept; no code begins another, so it needs no separator behind it."""
    return F.regexp_extract(e, _CODE, 0)


def _title(e: Column) -> Column:
    return F.regexp_extract(e, "^" + _TITLED, 0)


def _gender(e: Column) -> Column:
    """By the form of address; behind Dr and Prof by a given name of the lists, else neutral."""
    given = F.regexp_extract(F.lower(F.substr(e, F.length(_title(e)) + 1)), r"^([^ ]+) ", 1)
    of = lambda g: given.isin(*(w for (gender, _), words in _GIVEN.items() if gender == g for w in words.split()))
    return F.when(e.rlike(f"^(?:{_FEMALE})(?![\\p{{L}}])"), "f ").when(e.rlike(f"^(?:{_MALE})(?![\\p{{L}}])"), "m ").when(of("f"), "f ").when(of("m"), "m ").otherwise("n ")


def surname(form: Column) -> Column:
    """The surname of a name's canonical form."""
    return F.substring_index(form, " ", -1)


def canon(kind: Column, e: Column) -> Column:
    small = F.when(F.length(F.lower(e)) == F.length(e), F.lower(e)).otherwise(e)
    return (
        F.when(kind == "email", small)
        .when(kind == "iban", F.replace(e, F.lit(" ")))
        .when(kind == "ip", e)
        .when(kind == "phone", F.regexp_replace(F.substr(e, F.length(_country(e)) + 1), "[^0-9]", ""))
        .when(kind == "name", F.concat(_gender(e), F.lower(F.substr(e, F.length(_title(e)) + 1))))
        .otherwise(F.regexp_replace(e, "[^0-9]", ""))
    )


# ---- canonical form -> canonical form of the surrogate ------------------------------------------------


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: expressions are trees, not graphs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(secret: str, kind: Column, form: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), kind, form, attempt.cast("string")), 256)


def _number(digest: Column, i: Column) -> Column:
    """The i-th number of a digest, from 0 to 65535; they repeat after 60."""
    return F.conv(F.substr(digest, (i % 60 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _letter(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _word(words: str, n: Column) -> Column:
    return F.element_at(F.split(F.lit(words), " "), (n % len(words.split()) + 1).cast("int"))


def _chars(e: Column) -> Column:
    return F.filter(F.split(e, ""), lambda c: c != "")


def _swap(c: Column, n: Column) -> Column:
    """A character of the same kind, script and case; other characters stay."""

    def small(lower: Column) -> Column:
        out = F
        for pattern, letters in _LETTERS.items():
            out = out.when(lower.rlike(f"^{pattern}$"), _letter(letters, n))
        return out.otherwise(lower)

    return bind(F.lower(c), lambda lower: bind(small(lower), lambda new: F.when(c == lower, new).otherwise(F.upper(new))))


def _grown(form: Column, attempt: Column, by: str) -> Column:
    """Where a small space of surrogates is nearly taken, later attempts have one, two, ... characters more."""
    return F.concat(form, F.repeat(F.lit(by), F.greatest(F.ceil((attempt - GROW_AFTER) / 2), F.lit(0)).cast("int")))


def _swapped(form: Column, digest: Column) -> Column:
    return F.array_join(F.transform(_chars(form), lambda c, i: _swap(c, _number(digest, i))), "")


def _digits(form: Column, digest: Column) -> Column:
    """As many digits; the first is 0 only where it was."""
    swap = lambda c, i: bind(_number(digest, i), lambda n: F.when((i == 0) & (c != "0"), n % 9 + 1).otherwise(n % 10).cast("string"))
    return F.array_join(F.transform(_chars(form), swap), "")


def _luhn(body: Column) -> Column:
    """The check digit behind a body of digits."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.reverse(_chars(body)), doubled), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _card(form: Column, digest: Column, original: Column) -> Column:
    """The first digit stays, which tells the network."""
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
    valid = F.right(original, F.lit(1)) == _luhn(body(original))
    new = F.concat(F.substr(form, F.lit(1), F.lit(1)), F.substr(_digits(form, digest), F.lit(2)))
    return bind(new, lambda x: F.when(valid, F.concat(body(x), _luhn(body(x)))).otherwise(x))


def _other(names: Column) -> Column:
    """Whether names have letters of other scripts than Latin and Cyrillic."""
    return F.length(F.regexp_replace(names, r"[\p{IsLatin}\p{IsCyrillic}\x20'’-]", "")) > 0


def _surname(name: Column, digest: Column, attempt: Column) -> Column:
    """It grows with the attempts."""
    script = name.rlike(r"\p{IsCyrillic}")
    places = F.sequence(F.lit(1), F.lit(3) + (attempt / 2).cast("int"))
    syllable = lambda i: bind(_number(digest, i * 4), lambda n: F.when(script, _word(_SYLLABLES["cyrillic"], n)).otherwise(_word(_SYLLABLES["latin"], n)))
    return F.when(_other(name), _swapped(name, digest)).otherwise(F.array_join(F.transform(places, syllable), ""))


def _name(form: Column, digest: Column, attempt: Column, secret: str, own: Column) -> Column:
    """form: gender, then one or two names, the last one a surname, replaced by itself at its own attempt; given names grow with the attempts."""

    def given(name: Column) -> Column:
        script = name.rlike(r"\p{IsCyrillic}")

        def word(i: Column) -> Column:
            out = F
            for (gender, alphabet), words in _GIVEN.items():
                out = out.when(form.startswith(gender) & (script if alphabet == "cyrillic" else ~script), _word(words, _number(digest, i * 4)))
            return out

        places = F.sequence(F.lit(0), (attempt / 2).cast("int"))
        return F.when(name == "", "").when(_other(name), F.concat(_swapped(name, digest), F.lit(" "))).otherwise(F.concat(F.array_join(F.transform(places, word), "-"), F.lit(" ")))

    last = bind(surname(form), lambda x: bind(_digest(secret, F.lit("surname"), x, own), lambda d: _surname(x, d, own)))
    return F.concat(F.substr(form, F.lit(1), F.lit(2)), bind(F.regexp_extract(form, "^. ([^ ]+) ", 1), given), last)


def _email(form: Column, digest: Column, attempt: Column, secret: str) -> Column:
    """The part before the at sign by the whole address, the domain by itself; the last label stays."""

    def domain(d: Column) -> Column:
        head, last = F.regexp_extract(d, r"^(.*)\.[^.]*$", 1), F.regexp_extract(d, r"\.[^.]*$", 0)
        return F.concat(bind(_digest(secret, F.lit("domain"), d, F.lit(0)), lambda own: _swapped(head, own)), last)

    return F.concat(_swapped(_grown(F.regexp_extract(form, "^[^@]*", 0), attempt, "a"), digest), F.lit("@"), bind(F.regexp_extract(form, "@(.*)$", 1), domain))


def surrogate(secret: str, kind: Column, form: Column, attempt: Column, own: Column) -> Column:
    """Canonical form of the surrogate of a canonical form; own: the attempt of a name's surname."""

    def by_kind(digest: Column) -> Column:
        octets = F.transform(F.split(form, r"\."), lambda o, i: (_number(digest, i * 4) % 254 + 1).cast("string"))
        return (
            F.when(kind == "email", _email(form, digest, attempt, secret))
            .when(kind == "iban", F.concat(F.substr(form, F.lit(1), F.lit(2)), _swapped(_grown(F.substr(form, F.lit(3)), attempt, "0"), digest)))
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "card", _card(_grown(form, attempt, "0"), digest, form))
            .when(kind == "name", _name(form, digest, attempt, secret, own))
            .when(kind == "surname", _surname(form, digest, attempt))
            .otherwise(_digits(_grown(form, attempt, "0"), digest))
        )

    return bind(_digest(secret, kind, form, attempt), by_kind)


# ---- layout -----------------------------------------------------------------------------------------


def _refill(e: Column, new: Column, slot: str) -> Column:
    """The characters of new, one after another, in the slots of e, and those left over behind it."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(c.rlike(slot), F.struct(F.concat(a["out"], F.substr(new, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    return F.aggregate(_chars(e), start, step, lambda a: F.concat(a["out"], F.substr(new, a["at"])))


def _recase(e: Column, new: Column) -> Column:
    """Capitals where e has them, matched from both sides of the at sign."""
    case = lambda old, to: F.array_join(F.zip_with(_chars(old), _chars(to), lambda o, n: F.when(F.coalesce(o == F.lower(o), F.lit(True)), n).otherwise(F.upper(n))), "")
    part, domain = "^[^@]*", "@.*$"
    return F.concat(*(case(F.regexp_extract(e, p, 0), F.regexp_extract(new, p, 0)) for p in (part, domain)))


def render(kind: Column, e: Column, new: Column) -> Column:
    """The surrogate's canonical form in the layout of the original."""
    names = F.substr(new, F.lit(3))
    own = F.substr(e, F.length(_title(e)) + 1)
    return (
        F.when(kind == "email", _recase(e, new))
        .when(kind == "ip", new)
        .when(kind == "phone", F.concat(_country(e), _refill(F.substr(e, F.length(_country(e)) + 1), new, "[0-9]")))
        .when(kind == "name", F.concat(_title(e), F.when(own == F.upper(own), F.upper(names)).otherwise(F.initcap(names))))
        .otherwise(_refill(e, new, "[A-Z0-9]"))
    )


# ---- operator ---------------------------------------------------------------------------------------


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _collisions(tried: DataFrame) -> DataFrame:
    """Of those whose surrogates meet all but one, and those whose surrogate is a real form."""
    met = tried.groupBy("kind", "new").agg(F.min("form").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = tried.join(met, ["kind", "new"]).where("form <> first").select("kind", "form")
    real = tried.join(tried.select("kind", F.col("form").alias("new")), ["kind", "new"], "left_semi").select("kind", "form")
    return met.unionAll(real).distinct()


def _with_surnames(forms: DataFrame) -> DataFrame:
    """Distinct rows of kind and form, and those of the names' surnames."""
    last = forms.where("kind = 'name'").withColumn("kind", F.lit("surname")).withColumn("form", surname(F.col("form")))
    return forms.unionByName(last).distinct()


def resolve(forms: DataFrame, secret: str, most_rounds: int = 40) -> DataFrame | None:
    """(kind, form, attempt) of the entities that need an attempt above 0; None if there are none. Surnames come before names."""
    new = surrogate(secret, F.col("kind"), F.col("form"), F.col("attempt"), F.col("own"))
    first = _resolve(forms.where("kind <> 'name'").withColumn("own", F.lit(0)), new, most_rounds)
    names = forms.where("kind = 'name'")
    if first is None:
        return _resolve(names.withColumn("own", F.lit(0)), new, most_rounds)
    own = first.where("kind = 'surname'").select(F.col("form").alias("__last"), F.col("attempt").alias("own"))
    names = names.join(own, surname(F.col("form")) == F.col("__last"), "left").select("kind", "form", F.coalesce("own", F.lit(0)).alias("own"))
    then = _resolve(names, new, most_rounds)
    return first if then is None else first.unionByName(then)


def _resolve(forms: DataFrame, new: Column, most_rounds: int) -> DataFrame | None:
    """new: the surrogate, told by kind, form, attempt and own."""

    def attempt(tried: DataFrame) -> DataFrame:
        return written(tried.withColumn("new", new), "tried")

    tried = attempt(forms.withColumn("attempt", F.lit(0)))
    for k in range(most_rounds):
        again = written(_collisions(tried).withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return tried.where("attempt > 0").select("kind", "form", "attempt") if k else None
        tried = attempt(tried.join(again, ["kind", "form"], "left").select("kind", "form", "own", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"surrogates still meet after {most_rounds} rounds")


def replace_entities(docs: DataFrame, *, text_col: str = "text", secret: str = "change-me", count_col: str | None = None) -> DataFrame:
    """The documents with every entity replaced; with count_col also the number of entities."""
    text = docs[text_col]
    # one pass over the texts; kept with the text's hash, so that entities with further attempts need no other
    found = docs.select(F.xxhash64(text).alias("__text"), F.explode(F.array_distinct(entities(text))).alias("e"))
    found = found.select("__text", kind_of(F.col("e")).alias("kind"), "e").select("__text", "kind", canon(F.col("kind"), F.col("e")).alias("form"))
    found = written(found, "found")
    forms = written(_with_surnames(found.select("kind", "form").distinct()), "forms")
    odd = resolve(forms, secret)
    attempts = None
    if odd is not None:
        keyed = _with_surnames(found)
        name = F.concat_ws("|", "kind", "form")
        attempts = keyed.join(odd, ["kind", "form"]).groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct(name, "attempt"))).alias("__attempts"))

    def tried(kind: Column, form: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(F.col("__attempts"), F.concat_ws("|", kind, form)), F.lit(0))

    def new(e: Column) -> Column:
        replaced = lambda kind, form: bind(surrogate(secret, kind, form, tried(kind, form), tried(F.lit("surname"), surname(form))), lambda x: render(kind, e, x))
        return bind(kind_of(e), lambda kind: bind(canon(kind, e), lambda form: replaced(kind, form)))

    between = F.split(text, ANY, -1)
    whole = F.concat(F.element_at(between, 1), F.array_join(F.zip_with(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), new), F.slice(between, 2, F.size(between)), lambda a, b: F.concat(a, b)), ""))
    rewritten = F.when(text.rlike(_MAYBE), whole).otherwise(text)
    df = docs if attempts is None else docs.join(attempts, F.xxhash64(text) == F.col("__text"), "left")
    cols = [rewritten.alias(c) if c == text_col else docs[c] for c in docs.columns]
    return df.select(*cols, *([F.size(entities(text)).cast("long").alias(count_col)] if count_col else []))
