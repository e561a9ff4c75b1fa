import random

import numpy as np

from quillgraph.llm import subjects as S

TERMS = {
    "law": ["tribunal", "plaintiff", "verdict", "subpoena", "contract breach"],
    "music": ["violin", "concerto", "rehearsal", "oboe", "sonata"],
    "sport": ["referee", "penalty kick", "striker", "relay race", "goalkeeper"],
}
FRAMES = ["The guide spends {n} pages on the {t} alone.", "Nobody had written down how the {t} came about.", "What remains open is the {t}."]
NEUTRAL = ["Nothing else was reported.", "Comments go to the shared inbox.", "This page was last checked in week {n}."]
PASSING = "One colleague was late because of a {t}."


def corpus(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main = r.sample(sorted(TERMS), r.choice([1, 1, 2]))
        lines = [r.choice(FRAMES).format(n=r.randint(1, 50), t=r.choice(TERMS[s])) for s in main for _ in range(4)]
        lines += [r.choice(NEUTRAL).format(n=r.randint(1, 50)) for _ in range(3)]
        if r.random() < 0.5:
            lines.append(PASSING.format(t=r.choice(TERMS[r.choice(sorted(TERMS))])))
        r.shuffle(lines)
        docs.append((i, " ".join(lines) if i % 2 else "\r\n".join(f"<li>{x}</li>" for x in lines), "x"))
        truth[i] = set(main)
    return docs, truth


def test_held_out_documents(spark):
    docs, truth = corpus(500, 1)
    r = random.Random(2)
    labels = [(i, (s.upper() if r.random() < 0.2 else f" {s}") if r.random() > 0.05 else r.choice(sorted(TERMS))) for i in range(300) for s in truth[i]]
    labels += [(0, None), (None, "law"), (1, "nonsense"), *labels[:20]]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, "Nothing else was reported.", "x"), (None, "The violin.", "x"), (1004, docs[7][1] * 400, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    s = spark.createDataFrame([("Law", "x"), ("music", "x"), ("sport", "x")], "subject string, text string")
    rows = S.document_subjects(d, l, s).collect()
    got = {}
    for row in rows:
        got.setdefault(row.doc_id, set()).add(row.subject)
    held = range(300, 500)
    assert np.mean([got.get(i, set()) == truth[i] for i in held]) > 0.95
    assert not {1000, 1001, 1002, 1003, None} & set(got) and got[1004] == got[7]
    assert len(rows) == len({(r.doc_id, r.subject) for r in rows})


def test_gradient_is_the_loss_s():
    model = S.Model(["a", "b"])
    s = S.Sample(["The violin plays. The verdict falls.\nThe violin plays."], np.array([[1, 0]], np.float32))
    assert len(s.weight) == 2 and s.weight.sum() == 3
    g = s.gradient(model, False)

    def loss():
        h = S._segments(S._segments(model.embedding[s.buckets], s.parts)[s.words], s.offsets)
        p = 1 / (1 + np.exp(-(h @ model.output + model.bias)))
        return -((s.target * np.log(p) + (1 - s.target) * np.log(1 - p)) * s.weight[:, None]).sum()

    for name, at in (("output", (3, 1)), ("bias", (0,)), ("embedding", (int(s.buckets[0]), 2))):
        x = getattr(model, name).astype(np.float64)
        setattr(model, name, x)
        x[at] += 1e-4
        up = loss()
        x[at] -= 2e-4
        down = loss()
        x[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-2 * max(1, abs(g[name][at]))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "The violin.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    s = spark.createDataFrame([("music",)], "subject string")
    assert S.document_subjects(d, none, s).count() == 0
    assert S.document_subjects(d.limit(0), none, s.limit(0)).count() == 0
    assert [tuple(r) for r in S.composition(none, d, S.F.lit(5)).collect()] == [("none", 1, 5, 1.0)]


def test_statements():
    v = S.Vocabulary()
    words, offsets, document = S.statements(["Ein Test. Zwei\r\n<b>drei</b> v2.0 x", "", "Ende"], v)
    names = [[v.words[w] for w in words[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert names == [["ein", "test"], ["zwei"], ["drei"], ["v", "x"], ["ende"]] and document.tolist() == [0, 0, 0, 0, 2]
