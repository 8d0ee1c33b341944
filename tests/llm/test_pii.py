"""Personal data: the certain spans against Python's regular expressions, and what the trees add."""

import hashlib
import random
import re

from tidewell.llm import pii
from tidewell.session import load

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group(0))]


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def agrees(rows, texts):
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == sha(base), texts[r.doc_id]
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in pii.KINDS]


def test_certain_spans_are_those_of_the_patterns(spark, small):
    docs = load(spark, small, "documents")
    agrees(pii.find(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_random_texts_of_few_letters(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("0123456789 .-+()@a_\nüß") for _ in range(draw.randint(0, 60))) for _ in range(600)]
    texts += ["".join(draw.choice("0125 -.") for _ in range(80)) for _ in range(300)] + ["".join(draw.choice("a.@-") for _ in range(30)) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-11112 3", "+1 (017) 555-7713)..", "𝔘𝔘 x@y.de 1.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    agrees(pii.find(docs).collect(), dict(enumerate(texts)))


def test_forms_that_the_patterns_miss_are_added(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    planted = {
        -1: ("and then 1 (017) 555-7713 rethsh on", ["phone:9:25"]),
        -2: ("erti ing 58382889437 4465758382889437 the on", ["card:21:37"]),
        -3: ("heitlich heit.60 (at) mail8.example.com the in", ["email:9:39"]),
        -4: ("the order of 12 and 2024-05-06, chapter 3.4", []),
    }
    models = pii.fit(pii.spans_of(docs))
    extra = spark.createDataFrame([(i, t) for i, (t, _) in planted.items()], "doc_id long, text string")
    for r in pii.select(pii.spans_of(extra), models).collect():
        more = [f"{k}:{s.start}:{s.stop}" for k in pii.KINDS for s in r[f"more_{k}"]]
        assert more == planted[r.doc_id][1], r
    # few documents without a certain span get one
    clean = [r for r in pii.find(docs).collect() if not (r.n_email + r.n_ip + r.n_card + r.n_phone)]
    assert sum(r.n_added > 0 for r in clean) <= 0.02 * len(clean)


def test_edges(spark):
    rows = [(None, None, "x"), (1, "", "y"), (1, "a@b.de", None), (1, "a@b.de", None), (2, "x " * 40_000 + "1.2.3.4 " + "7" * 100_000 + "a@b.c" * 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumnsRenamed({"spans": "Spans"})
    found = pii.find(docs).collect()
    assert len(found) == 5
    by = sorted((r.doc_id or 0, r.spans, r.n_email) for r in found)
    assert by[0] == (0, "", 0) and by[1] == (1, "", 0) and by[2] == by[3] == (1, "email:0:6", 1)
    assert by[4][1] == ",".join(plain(rows[4][1]))
    assert pii.find(docs.where("false")).count() == 0


def test_no_python_on_the_main_path(spark, small):
    plan = pii.spans_of(load(spark, small, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
