"""Personal data against a plain Python search and put-together, and the odd formats."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from flowlaw.llm import pii

from .fixtures import empty, frame, rows

PLAIN = regex.compile(pii.PATTERN.replace(r"\z", r"\Z"))
NAME = regex.compile(rf"({pii.TITLE}) (?:(\S+) )?(\S+)")


def plain_units(text):
    """(before, value) of every unit, and the tail, without any hint."""
    out, at = [], 0
    for m in PLAIN.finditer(text or ""):
        before, at_ = text[at : m.start()], m.end()
        name = NAME.fullmatch(m[0])
        if name and not m[0][0].isdigit():
            out += [(f"{before}{name[1]} ", name[2]), (" ", name[3])] if name[2] else [(f"{before}{name[1]} ", name[3])]
        else:
            out.append((before, m[0]))
        at = at_
    return out, (text or "")[at:]


def texts():
    draw = random.Random(3)
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    makes = (
        lambda: f"{draw.choice(['a.b', 'Q', 'x_1'])}{digits(2)}@host{digits(1)}.example.com",
        lambda: f"{draw.choice(pii.SECRETS)}{draw.choice('=:')}{''.join(draw.choices('abcXYZ019', k=draw.randint(4, 80)))}",
        lambda: "AKIA" + "".join(draw.choices("ABCXYZ0123", k=16)),
        lambda: "".join(draw.choices("0123456789abcdef", k=draw.randint(30, 90))),
        lambda: ".".join(str(draw.randint(0, 270)) for _ in range(draw.randint(3, 5))),
        lambda: ":".join(f"{draw.randint(0, 65535):x}" for _ in range(draw.randint(7, 9))),
        lambda: f"{draw.choice(['DE', 'GB', 'Xx'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
        lambda: draw.choice(["", "-", " "]).join(digits(4) for _ in range(4)),
        lambda: draw.choice(["+1 (608) 555-2280", "+44 20 7946 0958", "555.123.4567", "020 7946 0958", "608-555-2280", "123-45-6789", "(608) 555-2280"]),
        lambda: f"{draw.choice([*pii.FEMALE, *pii.MALE])} {draw.choice(['Anna Miller', 'Miller', 'Ольга Иванова', 'O’Neil', 'lower', 'MILLER'])}",
        lambda: draw.choice(["Miller", "plain words", "1.5", "a:b:c", "Mr", "@", "token"]),
    )
    return [draw.choice(["so ", "", "(", "x", "end. "]) + draw.choice([" ", ", ", "\n", ""]).join(draw.choice(makes)() for _ in range(draw.randint(0, 6))) + draw.choice(["", " now", "."]) for _ in range(600)]


def test_units_equal_a_plain_search(spark):
    """Every match implies a hint, and texts are cut where a search without hints cuts them."""
    all_ = [*texts(), *(r[1] for r in rows())]
    found = pii.with_units(spark.createDataFrame([(i, t) for i, t in enumerate(all_)], "i int, _text string")).collect()
    for r in found:
        units, tail = plain_units(all_[r.i])
        if units:
            assert [(u.before, u.value) for u in r._units] == units and r._tail == tail, all_[r.i]
        else:
            assert r._units is None


def test_texts_are_put_together(spark):
    """What stands between entities stays, equal values get equal replacements, and different ones different ones."""
    all_ = texts()
    new = {r.i: r for r in pii.replaced(spark.createDataFrame([(i, t) for i, t in enumerate(all_)], "i int, text string").repartition(3), "key").collect()}
    given: dict[str, str] = {}
    for i, text in enumerate(all_):
        units, tail = plain_units(text)
        assert new[i].pii_units == len(units)
        if units:
            found = regex.fullmatch("".join(f"{regex.sub(r'Miller|MILLER|Иванова|O’Neil', '.*', regex.escape(b, literal_spaces=True))}(.+?)" for b, _ in units) + regex.sub(r"Miller|MILLER|Иванова|O’Neil", ".*", regex.escape(tail, literal_spaces=True)), new[i].text, regex.DOTALL)
            assert found, (text, new[i].text)
            if len(units) == 1 and new[i].text.startswith(units[0][0]) and new[i].text.endswith(tail):
                value = new[i].text[len(units[0][0]) : len(new[i].text) - len(tail)]
                assert given.setdefault(units[0][1], value) == value
    assert len(given) > 60 and len(set(given.values())) == len(given) and not set(given) & set(given.values())


def one(spark, *texts_):
    found = pii.replaced(spark.createDataFrame(list(enumerate(texts_)), "i int, text string"), "key").orderBy("i").collect()
    return [r.text for r in found]


def test_names_are_the_same_in_any_case(spark):
    a, b, c = one(spark, "Mr. Smith left.", "Then Mr. SMITH came, and Smith said: Smithson.", "Smith alone")
    family = a[4:-6]
    assert family != "Smith" and b == f"Then Mr. {family.upper()} came, and Smith said: Smithson." and c == "Smith alone"
    d, e = one(spark, "Mrs. Ada Stone: Stone, Stones; Mr. Poe", "x")
    given, stone, poe = regex.fullmatch(r"Mrs\. (\S+) (\S+): \S+, Stones; Mr\. (\S+)", d).groups()
    assert d == f"Mrs. {given} {stone}: {stone}, Stones; Mr. {poe}" and e == "x"


def test_kinds_stay(spark):
    old = ["at 10.1.2.3 now", "at 192.168.7.7 now", "at 172.20.1.1 now", "at 8.8.4.4 now", "by DE89 3704 0044 0532 0130 00 now", "v 2001:db8:85a3:0:0:8a2e:370:7334 now", "on 555.123.4567 now", "on 020 7946 0958 now"]
    new = one(spark, *old)
    want = [r"at 10\.\d+\.\d+\.\d+ now", r"at 192\.168\.\d+\.\d+ now", r"at 172\.20\.\d+\.\d+ now", r"at (?!10\.|127\.)\d+\.\d+\.\d+\.\d+ now", r"by DE\d\d( \d{4}){4} \d\d now", r"v 2001:db8(:[0-9a-f]{4}){6} now", r"on \d{3}\.\d{3}\.\d{4} now", r"on \d{3} \d{4} \d{4} now"]
    for a, b, w in zip(old, new, want):
        assert a != b and regex.fullmatch(w, b), (a, b)


@pytest.mark.parametrize("kind, values", [("secret", [f"{i:03d}" for i in range(1000)]), ("phone", [f"{i}-{j}" for i in range(10) for j in range(10)]), ("secret", ["aB1", "zZ9", "7"])])
def test_a_full_format(spark, kind, values):
    """As many values as the format has forms: all are dealt out, each once, in the same format."""
    frame_ = spark.createDataFrame([(kind, v) for v in values], "kind string, value string")
    found = {r.value: r.replacement for r in pii.surrogates(frame_, "key", rounds=2).collect()}
    assert set(found) == set(values) and len(set(found.values())) == len(values)
    shape = lambda v: regex.sub("[A-Z]", "A", regex.sub("[a-z]", "a", regex.sub("[0-9]", "0", v)))
    assert all(shape(a) == shape(b) for a, b in found.items())


def test_rows(spark):
    """A text that very many rows have, other columns with like names, no id, nothing at all."""
    many = spark.range(3000).select(F.lit("Mr. Smith, a@b.example.org").alias("text"), F.col("id").alias("_mark"), F.lit(9).alias("pii_units"), F.lit(1).alias("_units"))
    found = pii.replaced(many, "key")
    assert found.columns == ["text", "_mark", "_units", "pii_units"]
    got = found.groupBy("text", "pii_units").count().collect()
    assert [(r.pii_units, r["count"]) for r in got] == [(2, 3000)]
    assert pii.replaced(empty(spark), "key").count() == 0 and pii.replaced(frame(spark), "key").count() == len(rows())
    assert [r.text for r in pii.replaced(spark.createDataFrame([(None,), ("",)], "text string"), "key").collect()].count(None) == 1


def test_all_addresses_of_a_network(spark):
    """More private addresses than leave room for other ones: all get one of their own in the same network."""
    values = [f"192.168.{a}.{b}" for a in range(250) for b in range(0, 256, 2)]
    found = {r.value: r.replacement for r in pii.surrogates(spark.createDataFrame([("ip", v) for v in [*values, "10.1.2.3"]], "kind string, value string"), "key", rounds=1).collect()}
    assert len(found) == len(values) + 1 and len(set(found.values())) == len(found) and all(a != b for a, b in found.items())
    assert all(regex.fullmatch(r"192\.168\.\d{1,3}\.\d{1,3}", found[v]) for v in values) and found["10.1.2.3"].startswith("10.")


@pytest.mark.parametrize("rounds", [0, 2])
def test_names_without_draws(spark, rounds):
    """Even where no draw is left, no name stays, different ones differ, and script, case and signs are kept."""
    values = [("given f", "Мария"), ("family", "Иванов"), ("family", "ИВАНОВ"), ("family", "Παπαδόπουλος"), ("family", "王"), ("family", "O'Brien-Smythe"), ("family", "Le"), ("given n", "Robin"), ("family", "김"), ("family", "מזרחי")]
    found = {r.value: r.replacement for r in pii.surrogates(spark.createDataFrame(values, "kind string, value string"), "key", rounds=rounds).collect()}
    shapes = {"Мария": r"\p{Cyrillic}+-\p{Cyrillic}+", "Иванов": r"\p{Lu}\p{Cyrillic}+", "ИВАНОВ": r"[\p{Lu}]+", "Παπαδόπουλος": r"\p{Greek}+", "王": r"\p{Han}+", "O'Brien-Smythe": r"\p{Lu}\p{L}+'\p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+", "Le": r"\p{Lu}\p{Ll}+", "Robin": r"\p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+", "김": r"\p{Hangul}+", "מזרחי": r"\p{Hebrew}+"}
    for value, shape in shapes.items():
        assert regex.fullmatch(shape, found[value]) and found[value].lower() != value.lower(), (value, found[value])
    assert found["Иванов"].upper() == found["ИВАНОВ"] and len({v.lower() for v in found.values()}) == len(found) - 1


def test_permuted_formats(spark):
    """Images are one to one, in the same format, and never the value; cards keep what their check digit says."""
    values = [("card", f"{n:016d}"[:1] + f"{n * 7919 % 10**15:015d}") for n in range(300)] + [("phone", f"0{n:03d}") for n in range(300)] + [("secret", f"a{n:02d}Z") for n in range(100)] + [("iban", f"DE{n:02d}A") for n in range(100)]
    frame_ = spark.createDataFrame(values, "kind string, canon string").distinct()
    found = frame_.withColumn("image", pii.permuted(F.col("kind"), F.col("canon"), "key")).withColumn("same", pii._luhn(F.col("canon")) == pii._luhn(F.col("image"))).collect()
    assert len({(r.kind, r.image) for r in found}) == len(found) and all(r.image != r.canon and len(r.image) == len(r.canon) for r in found)
    assert all(r.same and r.image[0] == r.canon[0] for r in found if r.kind == "card") and all(r.image.startswith("DE") for r in found if r.kind == "iban")


def test_more_titles_and_columns(spark):
    new = one(spark, "Dr. Miller met MR. SMITH and Mr. 王 there", "Prof. Anna Stone")
    assert not any(x in new[0] for x in ("Miller", "SMITH", "王")) and "Stone" not in new[1] and "Anna" not in new[1]
    clash = spark.createDataFrame([("Mr. Smith", 1, 2, 3)], "text string, _pad int, _0 int, _row int")
    (r,) = pii.replaced(clash, "key").collect()
    assert (r["_pad"], r["_0"], r["_row"], r.pii_units) == (1, 2, 3, 1) and "Smith" not in r.text
