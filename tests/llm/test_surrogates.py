import re

from pyspark.sql import functions as F

from personagraph.llm import surrogates as S

from . import fixtures

TEXTS = [
    "Mail Anna.Bell+3@Mail.example.org, anna.bell+3@mail.example.org and ANNA.BELL+3@MAIL.EXAMPLE.ORG.",
    "Call +1 (017) 555-7713, pay 4111 1111 1111 1111 or 4111111111111111 from 10.2.3.4, id 123-45-6789.",
    'token = "hunter2hunter" and b44e15e09fd311c3cf3163b66d5a9875b883d8ce; DE89 3704 0044 0532 0130 00',
    "Mr. John Smith met Mrs Smith, Maria Weber and Господин Иванов; Dr. Weber wrote to Κυρία Παππά.",
    "Version 2.0 of 1,000 pages; 12 34; a@b; plain prose of the year 2024.",
]


def replaced(spark, texts, **options):
    df = fixtures.docs(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    return {r["doc_id"]: r["text"] for r in S.replace(df, **options).collect()}


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def test_format_and_coreference(spark):
    got = replaced(spark, TEXTS)
    a, b, c = re.findall(r"[\w.+]+@[\w.]+\w", got[0])
    assert a == b and c == a.upper() and "bell" not in got[0].lower() and a.endswith(".example")
    assert re.fullmatch(r"Call \+\d \(\d{3}\) \d{3}-\d{4}, pay (\d{4} ){3}\d{4} or \d{16} from \d+(\.\d+){3}, id \d{3}-\d\d-\d{4}\.", got[1])
    spaced, plain = re.search(r"pay ([\d ]+) or (\d+)", got[1]).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and luhn(plain)
    assert re.fullmatch(r'token = "[a-z]{6}\d[a-z]{6}" and [0-9a-f]{40}; [A-Z]{2}\d\d( \d{4}){4} \d\d', got[2])
    assert "hunter" not in got[2] and "b44e15e0" not in got[2]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+), (\w+) (\w+) and Господин (\w+); Dr\. (\w+) wrote to Κυρία (\w+)\.", got[3])
    assert m[2] == m[3] and m[5] == m[7] and m[2] != m[5]
    assert m[1] in S.POOLS["latin", "m"] and m[4] in S.POOLS["latin", "f"]
    assert m[6] in S.POOLS["cyrillic", "family"] and m[8] in S.POOLS["greek", "family"]
    assert got[4] == TEXTS[4]


def test_distinct_in_crowded_formats(spark):
    # 200 of 1000 three-digit numbers, and more names than the pool holds: many first draws collide.
    forms = spark.createDataFrame([("ssn", f"{k:03d}") for k in range(0, 1000, 5)] + [("family latin", f"Name{k}") for k in range(50)], "kind string, form string")
    rows = S.surrogates(forms).collect()
    assert len(rows) == 250
    assert len({(r["kind"], r["surrogate"]) for r in rows}) == 250
    assert not {(r["kind"], r["surrogate"]) for r in rows} & {(r["kind"], r["form"]) for r in rows}


def test_forms_with_few_free_values(spark):
    secrets = ["******", "......", "пароль", "ΚΩΔΙΚΌΣ", "密码密码密码", "😀😀😀😀😀😀", "*****a", "٣٣٣٣٣٣"]
    mail = [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    forms = spark.createDataFrame([("secret", x) for x in secrets] + [("email", x) for x in mail] + [("ssn", str(k)) for k in range(10)], "kind string, form string")
    rows = S.surrogates(forms).collect()
    made = {(r["kind"], r["form"]): r["surrogate"] for r in rows}
    assert len(rows) == len(made) == 44 and len({(r["kind"], r["surrogate"]) for r in rows}) == 44
    assert not {(r["kind"], r["surrogate"]) for r in rows} & set(made)
    assert re.fullmatch("[а-я]{6}", made["secret", "пароль"]) and re.fullmatch("[Α-Ω]{7}", made["secret", "ΚΩΔΙΚΌΣ"])
    assert re.fullmatch("[a-z]+@[a-z]+[.]example", made["email", "a@example.com"]) and len(made["secret", "******"]) == 6
    assert all(not set(made["secret", x]) & set(x) for x in ("密码密码密码", "😀😀😀😀😀😀", "٣٣٣٣٣٣"))


def test_odd_secrets_in_texts(spark):
    got = replaced(spark, ['password="******" and password: \'пароль\'', "from 10.2.3.4"], draws=0)
    m = re.fullmatch('password="([^"]+)" and password: \'([а-я]{6}[0-9])\'', got[0])
    assert m and m[1] != "******" and "пароль" not in got[0] and re.fullmatch(r"from \d+([.]\d+){4}", got[1])


def test_key_decides_and_reruns_agree(spark):
    assert replaced(spark, TEXTS) == replaced(spark, TEXTS)
    assert replaced(spark, TEXTS)[1] != replaced(spark, TEXTS, key="other")[1]


def test_odd_rows(spark):
    data = fixtures.rows()
    df = fixtures.docs(spark)
    got = S.replace(df)
    assert set(df.columns) < set(got.columns)
    assert sorted(map(str, (r["text"] for r in got.collect()))) == sorted(str(r[1]) for r in data)
    long = "x 10.2.3.4 " * 20_000
    assert len(set(replaced(spark, [long])[0].split())) == 2
    assert S.replace(fixtures.docs(spark, [])).count() == 0


def test_native_plan(spark):
    df = S.replace(fixtures.docs(spark)).select(F.col("text"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
