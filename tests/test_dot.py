"""Graph files with defaults, lists of estimates and paths, against plain restatements."""

import random

import pytest

from scaffweave.operators import graph as gr
from scaffweave.operators.numbering import last_up_to
from scaffweave.sources import dot


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_defaults_hold_from_where_they_stand(spark, tmp_path):
    rng = random.Random(3)
    names = [f"{i}{s}" for i in range(12) for s in "+-"]
    out, default, want = ["digraph adj {", "graph [k=31]"], (-30, 0.0, 0), {}

    def add(a, b, edge):
        old = want.get((a, b))
        best = edge if old is None else min(edge, old, key=lambda x: (x[1], -x[0]))
        want[a, b] = (*best[:2], edge[2] + (old[2] if old else 0))

    for n in names:
        out.append(f'"{n}" [l={len(n) * 100} C={names.index(n)}]')
    for _ in range(500):
        a, b, c = rng.sample(names, 3)
        kind = rng.randrange(6)
        d, e, n = rng.randrange(-30, 90), float(rng.randrange(1, 4)), rng.randrange(9)
        if kind == 0:
            default = (d, e, n)
            out.append(f"edge [d={d} e={e:.1f} n={n}]" + rng.choice(["", ";"]))
        elif kind == 1:
            out.append(f'"{a}" -> {{ "{b}" "{c}" }}')
            add(a, b, default)
            add(a, c, default)
        elif kind == 2:
            out.append(f'"{a}" -> "{b}" [d={d}]; {c} -> {a}')
            add(a, b, (d, 0.0, 0))
            add(c, a, default)
        elif kind == 3:
            out.append(f"{a} -> {b};")
            add(a, b, default)
        else:
            out.append(f'"{a}" -> "{b}" [d={d}, e={e:.1f}, n={n}]')
            add(a, b, (d, e, n))
    vertices, edges = dot.read_dot(spark, written(tmp_path, "a.dot", "\n".join([*out, "}"]) + "\n"))
    assert {(r.id, r.length, r.coverage) for r in vertices.collect()} == {(n, len(n) * 100, i) for i, n in enumerate(names)}
    assert {(r.src, r.dst): (r.d, r.e, r.n) for r in edges.collect()} == want


def test_files_keep_their_own_defaults(spark, tmp_path):
    one = written(tmp_path, "1.dot", 'digraph {\nedge [d=5 e=1.0 n=2]\n"a+" -> "b+"\n}\n')
    two = written(tmp_path, "2.dot", 'digraph { "a+" -> "b+"; "x" }\n')
    three = written(tmp_path, "3.dot", "graph g {\n0 [l=4];\n0--1 [d=3]; 1 -- 0 [d=7]\n}\n")
    _, edges = dot.read_dot(spark, one, two, three, k=11)
    assert sorted((r.file[-5], r.src, r.dst, r.d, r.e, r.n) for r in edges.collect()) == [("1", "a+", "b+", 5, 1.0, 2), ("2", "a+", "b+", -10, 0.0, 0), ("3", "0", "1", 7, 0.0, 0)]
    vertices, edges = dot.read_dot(spark, two)
    assert [(r.id, r.length) for r in vertices.collect()] == [("x", None)] and edges.first().d is None
    assert dot.read_dot(spark, written(tmp_path, "4.dot", "digraph {\n}\n"))[1].count() == 0
    with pytest.raises(Exception, match="no statement"):
        dot.read_dot(spark, written(tmp_path, "5.dot", 'digraph {\n"a" => "b"\n}\n'))[0].collect()


def test_carried_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), i, rng.choice([None, None, None, i]), rng.choice([None, str(i)])) for i in range(300)]
    got = last_up_to(spark.createDataFrame(rows, "g string, i int, a int, b string"), {"p": dot.F.col("a"), "q": dot.F.col("b")}, ["g"], ["i"]).collect()
    last, want = {}, set()
    for g, i, a, b in rows:
        old = last.get(g, (None, None))
        last[g] = (old[0] if a is None else a, old[1] if b is None else b)
        want.add((g, i, *last[g]))
    assert {(r.g, r.i, r.p, r.q) for r in got} == want


def test_estimates_by_contig(spark, tmp_path):
    lines = ["7 a+,10,5,2.0 b-,-3,4,1.5 ; c+,0,1,0.5", "8 ;", "9  ; x-,100,2,10.0", "a.b d+,1,1,1.0 ;"]
    rows = dot.read_estimates(spark, written(tmp_path, "x.dist", "\n".join(lines) + "\n"))
    got = sorted(tuple(r)[2:] for r in rows.collect())
    assert got == [
        ("7", False, 0, "a", "+", 10, 5, 2.0), ("7", False, 1, "b", "-", -3, 4, 1.5), ("7", True, 0, "c", "+", 0, 1, 0.5),
        ("9", True, 0, "x", "-", 100, 2, 10.0), ("a.b", False, 0, "d", "+", 1, 1, 1.0),
    ]
    back = {r.contig_id: r.value for r in dot.estimate_lines(rows).collect()}
    assert back == {"7": lines[0], "9": "9 ; x-,100,2,10.0", "a.b": lines[3]}
    with pytest.raises(Exception, match="no estimate"):
        dot.read_estimates(spark, written(tmp_path, "bad.dist", "7 a+,10,5 ;\n")).collect()


def test_properties_and_paths(spark):
    texts = ["l=10 C=5", "l = 10", "C=5, l=10", " 10 5", "x", None]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", gr.properties(dot.F.col("t")).alias("p")).orderBy("i").collect()]
    assert [p and tuple(p) for p in got] == [(10, 5), (10, None), (10, 5), (10, 5), None, None]
    contigs = spark.createDataFrame([("a", 100, 7), ("b", 50, 2), ("c", 30, 1)], "contig string, length long, coverage long")
    edges = spark.createDataFrame([("a", "+", "b", "-", -20), ("b", "-", "a", "+", 4), ("b", "-", "c", "+", -50)], "src string, src_strand string, dst string, dst_strand string, d int")
    path = lambda i, text: [(i, j, x[0], x[1]) for j, x in enumerate(text.split())]
    frame = lambda rows: spark.createDataFrame(rows, "path_id int, place int, contig string, strand string")
    found = gr.path_properties(frame(path(1, "a+ b- a+ b-") + path(2, "c+")), contigs, edges)
    assert sorted(map(tuple, found.collect())) == [(1, 4, 100 + 30 + 104 + 30, 18), (2, 1, 30, 1)]
    for wrong, text in (("a+ b+", "no edge"), ("b- c+", "weight -20"), ("z+", "no contig")):
        with pytest.raises(Exception, match=text):
            gr.path_properties(frame(path(1, wrong)), contigs, edges).collect()
