import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from codetally.llm import pii
from codetally.llm.queries import QUERIES
from tests.llm.conftest import prose


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if i % 2 == 0 else 2 * n - 9 * (2 * n > 9)
    return total % 10 == 0


def brute_base(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def brute_terms(rows, support=3, generalise=0.6, remove=0.9):
    """Spans of telling words, by row."""
    near, in_docs, with_entity = [], {}, {}
    for r, text in enumerate(rows):
        low = " " + (text or "").lower() + " "
        pattern = r"(?<=\s)([^\W\d_]{3,})(?=\s)"
        for term in {m[1] for m in re.finditer(pattern, low)}:
            in_docs[term] = in_docs.get(term, 0) + 1
        for start, _, kind, end in brute_base(text):
            value = text[start:end]
            entity = (kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())
            with_entity.setdefault(entity, set()).add(r)
            for m in re.finditer(pattern, low):
                s, e = m.start() - 1, m.end() - 1
                before = e < start and (s > start - 80 or start <= 80 and s >= 0)
                after = s > end and (e < end + 80 or len(text) - end <= 80)
                if before or after:
                    context = (text[max(0, start - 80) : start].lower(), text[end : end + 80].lower())
                    near.append((r, entity, m[1], s, e, context))
    contexts = {}
    for _, entity, term, _, _, context in near:
        contexts.setdefault((entity, term), set()).add(context)
    spans = {}
    for r, entity, term, start, end, _ in near:
        n, n_entity = len(contexts[entity, term]), len(with_entity[entity])
        if n >= support and n_entity < len(rows):
            ratio = round(math.log(len(rows) * n / (in_docs[term] * n_entity)) / math.log(len(rows) / n_entity), 6)
            if ratio >= generalise:
                kind = "removed" if ratio >= remove else "general"
                spans.setdefault(r, set()).add((start, pii.KINDS.index(kind), kind, end))
    return {r: sorted(s) for r, s in spans.items()}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    alphabets = ["a@.b-_ 1", "0123. ", "01 -+(.)4", "+1234567890 -().", "aé\U0001f600@.b 1"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(400)]
    return texts + [
        None, "", "x 4111 1111 1111 1111 y 4111-1111-1111-1111", "a@b.c_d@e.f a@b.c.@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1",
        "9" * 5000, "a" * 50000, "a@" + "b." * 9000 + "c", "+49 " * 3000, "1.2.3.4 " * 2000,
    ]


def test_base_spans_like_brute_force(spark, odd):
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, text string").repartition(4)
    body = F.coalesce("text", F.lit(""))
    for row in rows.select("i", pii.listed(pii.base_spans(body)).alias("spans")).collect():
        assert row.spans == joined(brute_base(odd[row.i])), repr(odd[row.i])[:200]


@pytest.fixture(scope="module")
def telling():
    """One address beside a name that is nowhere else, one beside a word that is sometimes elsewhere."""
    texts = [f"{prose(20, i)} Zorblax lives near bob@example.org with {prose(5, 50 + i)}" for i in range(6)]
    texts += [f"{prose(20, 100 + i)} tavern near 10.1.2.3 often {prose(30, 150 + i)}" for i in range(5)]
    texts += [f"{prose(10, 200 + i)} tavern near often {prose(10, 250 + i)}" for i in range(4)]
    texts += [prose(30, 300 + i) for i in range(60)]
    texts += ["copied context Quux amy@example.org Quux end"] * 7  # copies are one context
    return texts + [None, ""]


def test_telling_words_like_brute_force(spark, telling):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(telling)], "doc_id long, text string, hash string")
    found = pii.find_personal_data(rows).select("doc_id", "text", "spans", pii.sanitised(F.col("text"), F.col("spans")).alias("clean")).collect()
    terms = brute_terms(telling)
    assert {k for s in terms.values() for _, _, k, _ in s} == {"removed", "general"}
    for row in found:
        want = sorted(brute_base(row.text) + terms.get(row.doc_id, []))
        assert [(s.start, s.rank, s.kind, s.end) for s in row.spans] == want
        if row.text:
            marks = {"removed": "", "general": "[TERM]"}
            clean = row.text
            for start, _, kind, end in reversed(want):
                clean = clean[:start] + marks.get(kind, f"[{kind.upper()}]") + clean[end:]
            assert row.clean == clean
        else:
            assert row.clean == row.text


def spans_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find_personal_data(rows).select("doc_id", "spans").collect()}


def test_telling_words_far_from_the_entity(spark):
    """Everywhere in a document that holds the entity, in any case and beside any span, and in no other document."""
    far = prose(40, 7)
    texts = [f"{prose(20, i)} Zorblax lives near bob@example.org with {prose(5, 50 + i)} {far} ZORBLAX, {far}" for i in range(6)]
    texts += [f"Zorblax! {far} {prose(30, 90)} bob@example.org {far} Zorblax:amy@example.com"]
    texts += [prose(30, 300 + i) for i in range(60)]
    found = spans_of(spark, texts)
    for i, text in enumerate(texts):
        names = [(m.start(), m.end()) for m in re.finditer("zorblax", text, re.I)]
        assert [(s, e) for s, e, kind in found[i] if kind in ("removed", "general") and text[s:e].lower() == "zorblax"] == names
        assert len(names) == (2 if i < 7 else 0)


@pytest.mark.parametrize("copied", [0, 30])
def test_copies_change_nothing_for_others(spark, copied):
    texts = [f"{prose(20, i)} Zorblax lives near bob@example.org with {prose(5, 50 + i)}" for i in range(3)]
    texts += [f"{prose(20, 100 + i)} tavern near 10.1.2.3 often {prose(30, 150 + i)}" for i in range(5)]
    texts += [prose(30, 300 + i) for i in range(40)]
    more = spans_of(spark, texts + [texts[copied]] * 200)
    assert {i: more[i] for i in range(len(texts))} == spans_of(spark, texts)
    name = texts[copied].find("Zorblax")
    assert name < 0 or all((name, name + 7, "removed") in more[i] for i in (copied, len(texts), len(texts) + 199))


def test_overlapping_spans_are_replaced_once(spark):
    rows = spark.createDataFrame([(1, "call +4111 1111 1111 111 now")], "doc_id long, text string")
    [row] = pii.find_personal_data(rows).select(pii.sanitised(F.col("text"), F.col("spans")).alias("clean"), F.size("spans").alias("n")).collect()
    assert "1" not in row.clean
    assert row.n >= 1


def test_query(tables, documents, awkward):
    rows = QUERIES["op2_pii"](documents.sparkSession, tables(documents=documents)).collect()
    assert len(rows) == documents.count()
    for row in rows:
        if row.doc_id is not None:
            base = brute_base(awkward[row.doc_id])
            assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
            assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
            assert row.spans == joined(base)


def test_no_documents(no_documents):
    assert pii.find_personal_data(no_documents).count() == 0


def test_the_plan_is_native(documents):
    plan = pii.find_personal_data(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_clashing_columns(spark):
    names = ["_id", "_hash", "_of", "_terms", "id", "hash", "row", "telling", "of_id", "body"]
    docs = spark.createDataFrame([(1, "mail me@example.org", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = pii.find_personal_data(docs)
    assert found.columns == [*docs.columns, "base", "spans"]
    assert [[r[n] for n in names] for r in found.collect()] == [names, names]
    again = pii.find_personal_data(found.drop("spans")).collect()
    assert sorted(len(r.spans) for r in again) == [0, 1]
