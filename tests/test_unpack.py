import pytest

from pubscope.operators.unpack import read_cell, unpack

CELLS = [
    ("Ada, Mira; Bo, Jan", ["Ada, Mira", "Bo, Jan"]),
    ("“Ada, Mira”", ["Ada, Mira"]),
    ("“Bo, Jan”", ["Bo, Jan"]),
    ('["Ada, Mira", "Bo, Jan"]', ["Ada, Mira", "Bo, Jan"]),
    ('"Ada, Mira","The ""Cy"" Group"', ["Ada, Mira", 'The "Cy" Group']),
    ("1) Ada,Mira; 2) Bo,  Jan", ["Ada, Mira", "Bo, Jan"]),
    ("(1)Ada, Mira (2)Bo, Jan", ["Ada, Mira", "Bo, Jan"]),
    ("(1) Ada, Mira\n(2) Bo, Jan", ["Ada, Mira", "Bo, Jan"]),
    ("Ada, Mira (Ed.); ; Bo, Jan [Hrsg.]; et al.", ["Ada, Mira", "Bo, Jan"]),
    ("Ada, Mira, Bo, Jan, et al.", ["Ada, Mira", "Bo, Jan"]),
    ("Mira Ada, Jan Bo, and Eva Cyr (Hgg.)", ["Mira Ada", "Jan Bo", "Eva Cyr"]),
    ("Mira Ada & Jan Bo", ["Mira Ada", "Jan Bo"]),
    ("Ada, Mira / Bo, Jan and Cyr, Eva", ["Ada, Mira", "Bo, Jan", "Cyr, Eva"]),
    ('"Kollektiv Zu / Nord" (Ed.); Ada, Mira', ["Kollektiv Zu / Nord", "Ada, Mira"]),
    ("Ada, Mira؛ Bo, Jan", ["Ada, Mira", "Bo, Jan"]),
    ("van Ada, Mira, de la Bo, Jan", ["van Ada, Mira", "de la Bo, Jan"]),
    (None, []), ("", []), (" \xa0\t", []), (" ; , ; ", []), ("et al.", []),
]


def test_cells(spark):
    rows = [(i, c, "x", 7) for i, (c, _) in enumerate(CELLS)] + [(100 + i, "Ada, Mira", "y", 8) for i in range(5)]
    df = spark.createDataFrame(rows, "entry_id long, authors string, part string, pos int")
    got = {}
    for r in unpack(df, "entry_id", "authors", "author").collect():
        got.setdefault(r["entry_id"], {})[r["pos"]] = r["author"]
    assert {i: [v[p] for p in sorted(v)] for i, v in got.items() if i < 100} == {i: w for i, (_, w) in enumerate(CELLS) if w}
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_empty_table_and_repeated_ids(spark):
    schema = "id long, cell string"
    assert unpack(spark.createDataFrame([], schema), "id", "cell", "v").count() == 0
    got = unpack(spark.createDataFrame([(1, "A B; C D"), (1, "A B; C D"), (None, "E F")], schema), "id", "cell", "v").collect()
    assert sorted((r["id"] or 0, r["pos"], r["v"]) for r in got) == [(0, 1, "E F"), (1, 1, "A B"), (1, 1, "A B"), (1, 2, "C D"), (1, 2, "C D")]


def test_a_body_whose_name_has_a_conjunction_stays_whole(spark):
    rows = [(i, f"Institut für Wasser und Recht {c}o") for i, c in enumerate("BCDFGH")] + [(10 + i, f"{c}oda, Mira; {c}ele, Jan") for i, c in enumerate("BCDFGHJKLM")] + [(50, "“Institut für Wasser und Recht Zo”")]
    got = unpack(spark.createDataFrame(rows, "id long, cell string"), "id", "cell", "v").where("id < 10").collect()
    assert len(got) == 6


def test_very_long_cell(spark):
    cell = ", ".join(f"Name{'x' * (i % 7)}, Given{'y' * (i % 5)}" for i in range(300))
    got = unpack(spark.createDataFrame([(1, cell), (2, "“Namex, Giveny”")], "id long, cell string"), "id", "cell", "v").where("id = 1").count()
    assert got == 300


@pytest.mark.parametrize("cell", ['He said "x" once', 'unclosed "quote; next', '["not json'])
def test_odd_quotes_do_not_break(cell):
    assert read_cell(cell)


def test_a_body_with_many_delimiters_stays_whole(spark):
    body = "Institute of Art, Music, Film, Theatre, Dance, Law, History and Religion"
    rows = [(i, f"{c}oda, Mira; {c}ele, Jan") for i, c in enumerate("BCDFGHJKLM")] + [(50 + i, f"“{body}”") for i in range(5)] + [(90, body), (91, f"{body}, Mira Boda and Jan Cele")]
    got = {}
    for r in unpack(spark.createDataFrame(rows, "id long, cell string"), "id", "cell", "v").where("id >= 90").collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["v"]
    assert got == {90: {1: body}, 91: {1: body, 2: "Mira Boda", 3: "Jan Cele"}}


def test_a_cell_of_fifty_delimiters(spark):
    names = [f"{a}{b}ora {c}elin" for a in "BDFGK" for b in "aeiou" for c in "MN"]
    got = unpack(spark.createDataFrame([(1, ", ".join(names[:-1]) + " and " + names[-1])] + [(2 + k, n) for k, n in enumerate(names[:9])], "id long, cell string"), "id", "cell", "v").where("id = 1").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["pos"])] == names


def test_lattices_against_brute_force():
    import math
    from itertools import combinations

    from pubscope.operators import unpack as un

    model = un.Model({"s:C C": 40.0, "s:C , C": 30.0, "s:C w C & C": 9.0, "d:,:1": 20.0, "d:,:0": 15.0})
    parts = ["Ada Bo, Cy Do and Eva Fo", "Ada, Bo, Cy, Do", "House of Art and Law, Ada Bo / Cy Do"]
    lat = un.Lattices(parts)
    seen = lat.off[-1] * [0.0]
    import numpy as np

    hashes = lat.hashes()
    for m, rows, cut_at, weights, _ in lat.weights(model, np.array(seen)):
        e, like = un.forward_backward(m, cut_at, weights)
        start = un.viterbi(m, cut_at, weights)
        for a, r in enumerate(rows):
            words, between, _ = lat.read[r]
            ways = []
            for k in range(m):
                for cuts in combinations(range(1, m), k):
                    at = [0, *cuts, m]
                    ways.append((sum(weights[i][a, j - i - 1] + cut_at[a, j] for i, j in zip(at, at[1:])), at))
            total = math.log(sum(math.exp(w) for w, _ in ways))
            assert abs(total - like[a]) < 1e-9
            for i in range(m):
                for j in range(i, m):
                    share = sum(math.exp(w - total) for w, at in ways if (i, j + 1) in list(zip(at, at[1:])))
                    assert abs(share - e[i][a, j - i]) < 1e-9
            best = max(ways)[1]
            want = [un.tidy("".join(w + (between[k] if k + 1 < j else "") for k, w in enumerate(words[i:j], i))) for i, j in zip(best, best[1:])]
            assert un.segment(words, between, start[a]) == want
            assert hashes[lat.off[r]] == un.hash_of(words[0])
