import random
import re

from keelson.llm import pii


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in pii.replace_private(docs, key).collect()}


def luhn(digits):
    total = sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_kinds_and_formats(spark):
    texts = [
        "mail hein.19@mail5.example.com, again HEIN.19@MAIL5.EXAMPLE.COM.",
        "call +1 (743) 555-3824 or 743-555-1234; ssn 123-45-6789",
        "cards 4111111111111111 4111-1111-1111-1111 and 4785380592391138",
        "host 233.233.171.252 and 1.2.3.4.5 or 300.1.1.1",
        "IBAN DE89370400440532013000 spaced DE89 3704 0044 0532 0130 00 end",
        "Mr. John Smith met Mrs. Anna Smith. Dr. Smith left. г-жа Анна Иванова, г-н Иванов",
        "clean words 12 and 2024, a@b, 3.14", "", None, "hein.19@mail5.example.com" * 1,
    ]
    got = run(spark, texts)
    assert [got[i].text for i in (6, 7, 8)] == texts[6:9] and [got[i].n_entities for i in (6, 7, 8)] == [0, 0, 0]
    mail = re.findall(r"[\w.]+@[\w.]+\.(?:com|COM)", got[0].text)
    assert len(mail) == 2 and mail[0].upper() == mail[1] and mail[0] == got[9].text
    assert re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail[0]) and mail[0] != "hein.19@mail5.example.com"
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}; ssn \d{3}-\d\d-\d{4}", got[1].text)
    assert got[1].kinds == ["phone", "ssn"]
    a, b, c = re.findall(r"\d[\d-]{14,}\d", got[2].text)
    assert a == b.replace("-", "") and luhn(a) and luhn(c) == luhn("4785380592391138") and a[0] == c[0] == "4"
    assert re.fullmatch(r"host (\d+\.){3}\d+ and 1\.2\.3\.4\.5 or 300\.1\.1\.1", got[3].text) and "233.233.171.252" not in got[3].text
    one, two = re.findall(r"DE[\d ]+\d", got[4].text)
    assert one == two.replace(" ", "") and len(one) == 22
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Dr\. (\w+) left\. г-жа (\w+) (\w+), г-н (\w+)", got[5].text)
    assert names and names[2] == names[4] == names[5] != "Smith"
    assert names[1] in pii.GIVEN["m", "latin"] and names[3] in pii.GIVEN["f", "latin"] and names[6] in pii.GIVEN["f", "cyrillic"]
    assert re.fullmatch(r"[А-Яа-я]+а", names[7]) and re.fullmatch(r"[А-Яа-я]+", names[8])


def test_distinct_and_stable(spark):
    rng = random.Random(1)
    hosts = sorted({f"{rng.randrange(1, 3)}.0.{rng.randrange(40)}.{rng.randrange(200)}" for _ in range(1500)})
    people = sorted({"Mr. " + rng.choice("ABCDEF") + rng.choice(["al", "ben", "cor"]) + rng.choice("xyzuvw") + " Smith" for _ in range(90)})
    got = run(spark, hosts + people)
    new = [got[i].text for i in range(len(hosts))]
    assert len(set(new)) == len(hosts) and not set(new) & set(hosts)
    named = [got[len(hosts) + i].text for i in range(len(people))]
    assert len(set(named)) == len(people)
    assert {i: r.text for i, r in run(spark, hosts + people).items()} == {i: r.text for i, r in got.items()}
    assert run(spark, hosts[:3], "other")[0].text != got[0].text


def test_repeated_empty_and_long(spark):
    long = ("word " * 40000) + "a.b@c.example.org " + ("tail " * 40000)
    docs = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, "x@y.example.com x@y.example.com", 1)], "doc_id long, text string, found int")
    got = sorted(pii.replace_private(docs, "k").collect())
    assert len(got) == 3 and got[0].text == got[1].text and len(got[0].text) == len(long) and "a.b@c.example.org" not in got[0].text
    first, second = got[2].text.split()
    assert first == second and got[2].n_entities == 2
    assert pii.replace_private(docs.limit(0), "k").count() == 0


def test_one_person_has_one_surrogate(spark):
    text = "Mr Peter Schmidt met Dr Peter Schmidt. Later Peter Schmidt left, peter stayed. Anna Meyer wrote to Dr Anna Weber and PETER."
    got = run(spark, [text, "Prof. Peter Ling", "Peter Schmidt and Anna alone"])
    m = re.fullmatch(r"Mr (\w+) (\w+) met Dr (\w+) (\w+)\. Later (\w+) (\w+) left, peter stayed\. (\w+) Meyer wrote to Dr (\w+) (\w+) and (\w+)\.", got[0].text)
    assert m and m[1] == m[3] == m[5] == m[10].capitalize() and m[2] == m[4] == m[6] and m[7] == m[8]
    assert m[1] in pii.GIVEN["m", "latin"] and m[8] in pii.GIVEN["f", "latin"] and not {m[1], m[2], m[8], m[9]} & {"Peter", "Schmidt", "Anna", "Weber"}
    assert re.match(r"Prof\. (\w+) ", got[1].text)[1] == m[1] and got[0].n_entities == 10
    assert got[2].text == "Peter Schmidt and Anna alone" and got[2].n_entities == 0


def test_by_brute_force(spark):
    """Every planted entity is replaced, one for one over the corpus, and nothing else is."""
    rng = random.Random(9)
    pools = {
        "email": [f"user{i}@host{i % 7}.example.org" for i in range(40)], "ip": [f"10.{i}.7.{i + 3}" for i in range(40)],
        "ssn": [f"{100 + i}-4{i % 10}-{2000 + i}" for i in range(40)], "phone": [f"555-{200 + i}-{3000 + i}" for i in range(40)],
        "name": [f"{a}{b}" for a in ("Bal", "Cor", "Dim", "Fel") for b in ("ton", "wick", "ham", "rand", "lows")],
    }
    rows, plan = [], []
    for i in range(150):
        parts, put = [], []
        for _ in range(rng.randrange(5)):
            kind = rng.choice(list(pools))
            value = rng.choice(pools[kind])
            parts += [rng.choice(["see", "and", "(or)", "word,"]), ("Dr " if kind == "name" else "") + value]
            put.append((kind, value))
        rows.append(" ".join([*parts, "end"]))
        plan.append(put)
    got = run(spark, rows)
    forward, back = {}, {}
    for i, put in enumerate(plan):
        pattern = re.escape(rows[i])
        for _, value in put:
            pattern = pattern.replace(re.escape(value), r"([\w.@-]+)", 1)
        m = re.fullmatch(pattern, got[i].text)
        assert m and got[i].n_entities == len(put), (rows[i], got[i].text)
        for (kind, value), new in zip(put, m.groups()):
            assert forward.setdefault((kind, value), new) == new and back.setdefault((kind, new), value) == value
            assert new not in pools[kind]


def test_null_ids_and_ties(spark):
    docs = spark.createDataFrame([(None, "a@b.example.com"), (None, "a@b.example.com"), (1, "a@b.example.com"), (1, None)], "doc_id long, text string")
    got = pii.replace_private(docs, "k").collect()
    assert len(got) == 4 and len({r.text for r in got}) == 2 and sorted(r.n_entities for r in got) == [0, 1, 1, 1]
