import random
import re
import unicodedata

import regex
from pyspark.sql import functions as F

from tests.llm.helpers import empty_documents, odd_documents
from textquarry.llm import surrogates as S


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


ROWS = [
    (1, "Mail hein.19@mail5.example.com or HEIN.19@MAIL5.EXAMPLE.COM; éé.12@x.org."),
    (2, "Call +1 (743) 555-3824, (743) 555-3824; 743-555-3824!"),
    (3, "ip 10.2.3.4, not 999.1.1.1; card 4111 1111 1111 1111 and 4785380592391139, ssn 123-45-6789"),
    (4, "Mrs. Anna Smith met Mr. SMITH and Г-жа Иванова. Г-н Иванов."),
    (5, "IBAN DE89 3704 0044 0532 0130 00."),
    (6, "nothing here 12 34, a@b, 1.2.3, ring 12345"),
    (7, None),
    (8, ""),
]


def test_types_formats_and_coreference(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, text string, form string")
    out = {r["doc_id"]: r for r in S.replace_entities(df, count_col="n").collect()}
    text = {i: out[i]["text"] for i, _ in ROWS}
    assert [out[i]["n"] for i in range(1, 9)] == [3, 3, 4, 4, 1, 0, 0, 0]
    assert (text[6], text[7], text[8]) == (ROWS[5][1], None, "")
    a, b = re.match(r"Mail (\S+) or (\S+);", text[1]).groups()
    assert a.lower() == b.lower() and b == b.upper() and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a) and a != "hein.19@mail5.example.com"
    phones = re.findall(r"[\d(][\d() -]{8,}\d", text[2])
    digits = [re.sub(r"\D", "", p)[-10:] for p in phones]
    assert len(set(digits)) == 1 and digits[0] != "7435553824" and text[2].startswith("Call +1 (")
    ip, card, other, ssn = re.search(r"ip (\S+), not 999.1.1.1; card (.{19}) and (\d{16}), ssn (\S+)", text[3]).groups()
    assert all(1 <= int(o) <= 254 for o in ip.split(".")) and ip != "10.2.3.4"
    assert luhn(card.replace(" ", "")) and card[0] == "4" and other[0] == "4" and re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn)
    female, male, ru_f, ru_m = re.match(r"Mrs\. (\w+ \w+) met Mr\. (\w+) and Г-жа (\w+)\. Г-н (\w+)\.", text[4]).groups()
    assert female.split()[0].lower() in S._GIVEN["f", "latin"].split() and male == male.upper()
    assert re.fullmatch("[А-Я][а-я]+", ru_f) and re.fullmatch("[А-Я][а-я]+", ru_m)
    assert re.fullmatch(r"IBAN DE\d\d( \d{4}){4} \d\d\.", text[5])


def test_key_changes_surrogates_and_runs_agree(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    one, two, other = ({r["doc_id"]: r["text"] for r in S.replace_entities(df, secret=s).collect()} for s in ("a", "a", "b"))
    assert one == two and one[1] != other[1]


def test_distinct_entities_stay_distinct(spark):
    """All addresses of a domain of few surrogates: the collisions are found and resolved."""
    rows = [(k, f"to {c}{d}@x.org now") for k, (c, d) in enumerate((c, d) for c in "abcdefghij" for d in range(10))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = [r["text"] for r in S.replace_entities(df).collect()]
    assert len(set(out)) == 100
    real = {t for _, t in rows}
    domain = re.search("@(.*) now", out[0])[1]
    assert domain == "x.org" or not set(out) & real


def test_native_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    plan = S.replace_entities(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_documents(spark):
    docs, rows = odd_documents(spark)
    out = S.replace_entities(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, (tuple(r) for r in docs.collect())))
    assert S.replace_entities(empty_documents(spark)).count() == 0


def test_long_text_is_quick(spark):
    df = spark.createDataFrame([(1, "a" * 300_000 + " b@c.de " + "1" * 50_000)], "doc_id bigint, text string")
    assert S.replace_entities(df, count_col="n").select(F.col("n")).first()["n"] == 1


def test_surnames_genders_and_country_codes(spark):
    said = [
        "Mr Weber; Mr John Weber; Dr Anna Weber; Mrs Anna Weber; Dr. WEBER; Prof Xenokrates Weber",
        "+1 743 555 3824; +17435553824; +1-743-555-3824; 743-555-3824",
        "+49 30 1234 5678; +493012345678; +49 (30) 12345678",
    ]
    said += [f"Mr {g} Weber; x; x" for g in ("Peter", "Paul", "Hugo", "Emil", "Otto", "Kurt", "Hans", "Max", "Tom", "Jan", "Leo", "Ben", "Tim", "Udo", "Uwe", "Kai", "Jörg", "Rolf")]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: r["text"].split("; ") for r in S.replace_entities(df).collect()}
    names = [n.split(" ")[1:] for n in out[0]]
    assert len({n[-1].lower() for n in names}) == 1 and names[0][-1] != "Weber"
    assert names[2] == names[3] and names[2][0].lower() in S._GIVEN["f", "latin"].split()
    assert names[5][0].lower() in S._GIVEN["n", "latin"].split()
    for k, digits in ((1, 10), (2, 10)):
        assert len({re.sub(r"[^0-9]", "", p)[-digits:] for p in out[k]}) == 1
    assert all(p.startswith("+49") for p in out[2])
    johns = [names[1], *(out[k][0].split(" ")[1:] for k in range(3, len(said)))]
    assert len({tuple(n) for n in johns}) == len(johns) and {n[-1] for n in johns} == {names[0][-1]}


def test_long_entities_do_not_crash(spark):
    """Nothing in the patterns recurses: 100,000 labels, name letters and separators."""
    n = 100_000
    texts = ["x@" + "a." * n + "com", "Mr A" + "b" * n + " C" + "d" * n, "1" + "-1" * n, "x" * n + "@" + "é" * n + ".org", "+1" + " 22" * n, "x@" + "a-" * n + ".b" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in S.replace_entities(df).collect()}
    assert out[0].count(".") == n and out[0].endswith(".com") and out[0] != texts[0]
    assert len(out[3]) == len(texts[3]) and out[3] != texts[3] and out[2] == texts[2]


def test_a_full_space_of_surrogates_grows(spark, monkeypatch):
    """All one-letter addresses of a domain are real, so their surrogates must be longer."""
    monkeypatch.setattr(S, "GROW_AFTER", 2)
    rows = [(k, f"{c}@x.org") for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    out = [r["text"] for r in S.replace_entities(df).collect()]
    assert len(set(out)) == 26 and not set(out) & {t for _, t in rows}
    assert all(re.fullmatch(r"[a-z]{1,9}@[a-z]\.org", t) for t in out)


def shape(entity):
    """Script or kind, and case, of each character."""
    def one(c):
        if c.isdigit():
            return "0"
        return unicodedata.name(c).split()[0] + str(c.isupper()) if c.isalpha() else c

    return "".join(map(one, entity))


def plain_form(entity):
    """Kind and what tells an entity from others, by plain string work."""
    if "@" in entity:
        return "email", entity.lower()
    if regex.match(r"[A-Z]{2}[0-9]{2}", entity):
        return "iban", entity.replace(" ", "")
    if regex.fullmatch(r"[0-9.]+", entity) and entity.count(".") == 3:
        return "ip", entity
    return "number", "".join(c for c in entity if c.isdigit())[-10:]


def test_against_brute_force(spark):
    """Entities found anew with another regular expression engine; what lies between stays, equal ones stay equal, others differ."""
    rng = random.Random(2)
    people = [f"{rng.choice('abcdef')}.{rng.choice(['weber', 'ивана', 'müller'])}{rng.randint(1, 40)}@mail{rng.randint(1, 3)}.org" for _ in range(60)]
    phones = [f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}" for _ in range(60)]
    cards = ["".join(str(rng.randint(0, 9)) for _ in range(16)) for _ in range(30)]
    others = [".".join(str(rng.randint(1, 254)) for _ in range(4)) for _ in range(30)] + [f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" for _ in range(30)]

    def layout(e):
        if e in people:
            return rng.choice([e, e.upper()])
        if e in phones:
            return rng.choice([e, f"({e[:3]}) {e[4:]}", f"+1 {e}", f"+1{e.replace('-', '')}", e.replace("-", ".")])
        return rng.choice([e, " ".join(e[i : i + 4] for i in range(0, 16, 4))]) if e in cards else e

    rows = [(k, "; ".join(rng.choice(["wort", "über 12", "a, b"]) + " " + layout(rng.choice(people + phones + cards + others)) for _ in range(rng.randint(0, 6)))) for k in range(200)]
    out = {r["doc_id"]: r["text"] for r in S.replace_entities(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    known, rendered = {}, {}
    for k, text in rows:
        # octets change their length, so texts are compared entity by entity
        old, new = (list(regex.finditer(S.ANY, t)) for t in (text, out[k]))
        assert regex.split(S.ANY, text) == regex.split(S.ANY, out[k]) and len(old) == len(new)
        for before, after in zip((m[0] for m in old), (m[0] for m in new), strict=True):
            form, put = plain_form(before), plain_form(after)
            assert form[0] == put[0] and (form[0] == "ip" or shape(before) == shape(after))
            assert known.setdefault(form, put) == put and rendered.setdefault(put, form) == form
    real = {plain_form(m[0]) for _, t in rows for m in regex.finditer(S.ANY, t)}
    assert len(known) > 100 and not set(rendered) & real


def test_texts_are_read_twice_at_most(spark):
    """Once for the entities and once to be rewritten, also where surrogates meet."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = [f"{c}@x.org and {c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"] + ["no one", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in S.replace_entities(docs.mapInArrow(counted, docs.schema)).collect()}
    assert seen.value == 2 * len(texts)
    assert len({got[k] for k in range(26)}) == 26 and all(len(set(got[k].split(" and "))) == 1 for k in range(26))
    assert (got[26], got[27]) == ("no one", None)
