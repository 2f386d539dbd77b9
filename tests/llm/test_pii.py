import re

import pytest

from tidemark.llm import pii as P

TEXT = (
    'Mail Und.34@mail7.example.com or und.34@MAIL7.example.com. Call +1 (017) 555-7713, from 1.2.3.4. Card 4012 8888 8888 1881, '
    'same 4012888888881881; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Mrs. Anna Schmidt met Mr Schmidt; Anna Schmidt left. SSN 123-45-6789.'
)


def test_detect_types():
    kinds = [(k, TEXT[s:e]) for s, e, k, *_ in P.detect(TEXT)]
    assert [k for k, _ in kinds] == ["email", "email", "phone", "ip", "number", "number", "secret", "name", "name", "name", "name", "name", "ssn"]
    assert P.detect(None) == P.detect("") == P.detect("clean words, 12 of them.") == []


@pytest.mark.parametrize(
    ("kind", "form"),
    [("email", "und.34@mail7.example.com"), ("phone", "+10175557713"), ("ip", "10.2.3.4"), ("ip", "8.8.8.8"), ("number", "4012888888881881"), ("number", "1234567890123456"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("ssn", "123456789"), ("iban", "DE89370400440532013000"), ("name", "иванов"), ("name", "anna")],
)
def test_surrogates_keep_type_and_format(kind, form):
    gender = "f" * (form == "anna")
    new = P.surrogate(kind, form, b"k", gender)
    assert new == P.surrogate(kind, form, b"k", gender) != form and new != P.surrogate(kind, form, b"k", gender, 1) and new != P.surrogate(kind, form, b"other", gender)
    if kind == "number":
        assert len(new) == len(form) and P.luhn(new) == P.luhn(form)
    if kind == "ip":
        assert [k for _, _, k, *_ in P.detect(f"at {new}.")] == ["ip"]
    if kind == "email":
        assert [k for _, _, k, *_ in P.detect(new)] == ["email"]
    if kind == "secret":
        assert re.fullmatch(r"[0-9a-f]{40}", new)
    if kind == "iban":
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    if form == "иванов":
        assert P.script(new) == "CYRILLIC"
    if form == "anna":
        assert new[-1] in "ae"


def test_replace(spark):
    rows = [(1, TEXT, "x"), (2, TEXT, "y"), (3, None, "x"), (4, "", "x"), (5, "clean", "x"), (6, "again und.34@mail7.example.com and other.1@mail7.example.com", "x"), (None, "ip 1.2.3.4", "x"), (1, TEXT, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = P.replace(df, b"k", count_col="n").collect()
    assert sorted((r.doc_id or 0, r.kind) for r in out) == sorted((r[0] or 0, r[2]) for r in rows)
    by = {r.doc_id: r for r in out}
    assert by[3].text is None and by[4].text == "" and by[5].text == "clean"
    new = by[1].text
    assert by[2].text == new and by[1].n == 13
    for private in ("34@mail7", "555-7713", "1.2.3.4", "1881", "04dbeb", "Schmidt", "Anna", "6789"):
        assert private not in new
    found = {(k, f) for _, _, k, f, _ in P.detect(new)}
    assert len(found) == len({(k, f) for _, _, k, f, _ in P.detect(TEXT)})  # distinct stays distinct, coreferent one
    mail = re.search(r"\S+@\S+", new)[0]
    assert mail.lower() in by[6].text.lower()
    assert len(set(re.findall(r"\S+@\S+", by[6].text))) == 2
    assert P.replace(df.limit(0), b"k").count() == 0


def test_assign_avoids_collisions(spark):
    forms = [(k, f"{i:03d}") for i in range(300) for k in ("secret",)]
    df = spark.createDataFrame(forms, "kind string, form string").selectExpr("*", "'' AS gender")
    out = P.assign(df, b"k").collect()
    assert len(out) == 300 and len({r.new for r in out}) == 300
    assert not {r.new for r in out} & {f for _, f in forms}


@pytest.mark.parametrize(
    "value",
    ["token=" + "aB3/" * 300, "0123456789abcdef" * 12, "ab.1" * 60 + "@mail.example.com", "x@" + "d" * 70 + ".example.com", "x@y." + "a" * 40, "x@" + "s." * 12 + "com", "AKIA" + "A1" * 12, "sk-" + "a1B" * 40, "Mrs. " + "Q" + "a" * 60],
)
def test_long_values_leave_nothing(value):
    (s, e, *_), *more = P.detect(f"see {value} end")
    assert not more and e == 4 + len(value) and s in (4, 4 + len("token="), 4 + len("Mrs. "))


def test_emails_end_to_end_and_long_runs():
    assert [text for text in (m[0] for m in P._emails("a@b.com5c@d.org, x@y.net"))] == ["a@b.com", "5c@d.org", "x@y.net"]
    assert P.detect("x" * 300_000 + " @ " + "y." * 100_000) == []


def test_assign_crowded_digit_formats(spark):
    forms = [("phone", f"+1{i:03d}") for i in range(900)] + [("phone", f"+{i}") for i in range(2000, 10_000)]
    df = spark.createDataFrame(forms, "kind string, form string").selectExpr("*", "'' AS gender")
    out = P.assign(df, b"k").collect()
    assert {(r.kind, r.form) for r in out} == set(forms)
    assert len({r.new for r in out}) == len(forms) and not {r.new for r in out} & {f for _, f in forms}
    assert P.render("phone", "+1 234", "+98765") == "+9 8765"


def replaced(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, __tm_key string, start string")
    out = P.replace(df, b"k")
    assert out.columns == df.columns
    rows = out.orderBy("doc_id").collect()
    assert {(r["__tm_key"], r.start) for r in rows} == {("x", "y")}
    return [r.text for r in rows]


def test_one_person_under_all_titles(spark):
    a, b = replaced(spark, "Mrs Anna Schmidt met Dr Anna Schmidt. Then Schmidt spoke, Anna agreed; Schmidt's hat. Annas stay, so does anna.", "Dr Anna Miller, Mr Anna")
    anna, schmidt = re.match(r"Mrs (\S+) (\S+) met", a).groups()
    assert a == f"Mrs {anna} {schmidt} met Dr {anna} {schmidt}. Then {schmidt} spoke, {anna} agreed; {schmidt}'s hat. Annas stay, so does anna."
    assert b.startswith(f"Dr {anna} ") and b.endswith(f", Mr {anna}") and anna[-1] in "ae" and anna.lower() != schmidt.lower()


def test_names_share_one_space(spark):
    names = [f"{a}{b}{c}" for a in "ABCDEFGHIJ" for b in "aeiou" for c in "bdfg"]
    df = spark.createDataFrame([("name", n.lower(), g) for n, g in zip(names, "mf" * 100, strict=True)] + [("number", f"{i:013d}", "") for i in range(50)] + [("phone", f"{i:013d}", "") for i in range(50, 90)], "kind string, form string, gender string")
    out = P.assign(df, b"k").collect()
    assert len(out) == len({(P.space(r.kind), r.new) for r in out}) == 290


def test_plain_words_are_no_secrets():
    for text in ("auth = username", "token=javascript", "the secret: Something", "API_KEY = PLACEHOLDER"):
        assert P.detect(text) == []
    for text in ("token = a1b2c3d4e5", "auth: abcDEFghiJ", "password=correcthorse"):
        assert len(P.detect(text)) == 1


def test_a_popular_text_is_looked_up_in_groups(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "'mail me@example.com' AS text")
    out = P.replace(df, b"k")
    assert len({r.text for r in out.collect()}) == 1 and out.count() == 400


def named(text):
    return [text[s:e] for s, e, kind, *_ in P.detect(text) if kind == "name"]


def test_title_chains_and_particles():
    assert named("Herr Dr. Hans Meyer kam.") == ["Hans", "Meyer"]
    assert {g for *_, g in P.detect("Frau Prof. Dr. Eva Kern")} == {"f", ""}
    assert named("MR. SMITH and Mr de la Cruz, Mrs van der Berg") == ["SMITH", "Cruz", "Berg"]
    assert named("Mr Smith and Jones") == ["Smith"] and named("Mr Drake Dr Mr Poe") == ["Drake", "Poe"]
    assert named("Mr and Mrs") == [] and named("Sir, no") == []
    assert named("Frau 田中 kam") == ["田中"]


@pytest.mark.parametrize("value", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1:2:3", "2001:db8::7334"])
def test_addresses_of_eight_parts(value):
    assert [(k, f) for _, _, k, f, _ in P.detect(f"at {value}, then")] == [("ip6", value.lower())]
    new = P.surrogate("ip6", value, b"k")
    assert new != value and [k for _, _, k, *_ in P.detect(new)] == ["ip6"]


def test_what_is_no_address():
    assert P.detect("std::vector a::b 12:30:45 cafe::bed x::1y 1:2:3") == []
    assert [k for _, _, k, *_ in P.detect("Tel 0171 2345678, 030/1234567")] == ["phone", "phone"]
    assert P.detect("0.123 456789 and 1,0123 456789") == []


@pytest.mark.parametrize("form", ["田中", "שלום", "संजय", "김철수", "иван", "анна", "αννα", "たなか"])
def test_names_keep_their_script(form):
    for gender in ("", "m", "f"):
        new = P.surrogate("name", form, b"k", gender)
        assert new != form and P.script(new) == P.script(form) != "LATIN"


def test_one_domain_stays_one(spark):
    rows = [(1, "a.b@acme.com and c.d@acme.com"), (2, "Anna.Smith@ACME.com, x@other.org"), (3, "y@acme.com")]
    out = {r.doc_id: r.text for r in P.replace(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    mails = [m for i in (1, 2, 3) for m in re.findall(r"[^\s,]+@[^\s,]+", out[i].lower())]
    domains = [m.split("@")[1] for m in mails]
    assert len(set(mails)) == 5 and len({domains[k] for k in (0, 1, 2, 4)}) == 1 and domains[3] != domains[0]
    assert not any("acme" in d or "other.org" in d for d in domains)
