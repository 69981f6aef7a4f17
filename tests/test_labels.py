from framelake.operators import labels

SYMBOLS = [("chL", "ch", "Left"), ("chR", "ch", "Right"), ("chC", "ch", "Center"), ("sgST", "sg", "Standard Stereo"), ("sgM", "sg", "Monoaural"), ("ggMPg", "gg", "Main Program"), ("ggAPg", "gg", "Alternative Program")]


def inserted(spark, text):
    rows = []
    for seq, r in enumerate(labels.parse_labels(text)):
        p = dict(r["props"])
        rows.append((1, r["track"], seq, r["tag"], p.pop("id", None), p.pop("repeat", "true") not in ("false", "0", "no"), int(p.pop("chan")) if "chan" in p else None, p))
    df = spark.createDataFrame(rows, "file int, track long, seq long, tag string, id string, repeat boolean, channel int, props map<string,string>")
    out = labels.insert_labels(df, spark.createDataFrame(SYMBOLS, "tag string, kind string, name string"), "file")
    return {r.seq: r for r in out.collect()}


def test_a_stereo_pair_over_two_tracks(spark):
    got = inserted(spark, "0\nchL\nsgST, id=sg1\nggAPg, id=gosg1, lang=fr\n\n1\nchR\nsgST, id=sg1, repeat=false\nggAPg, id=gosg1, repeat=false\n")
    assert [(got[k].kind, got[k].label, got[k].stored, got[k].group, got[k].groups, got[k].problem) for k in range(6)] == [
        ("ch", 0, True, 1, None, None), ("sg", 1, True, None, [2], None), ("gg", 2, True, None, None, None), ("ch", 3, True, 1, None, None), ("sg", 1, False, None, [2], None), ("gg", 2, False, None, None, None)]
    assert got[5].inherited == {"lang": "fr"} and got[3].name == "Right"


def test_groups_of_one_track_and_repeats(spark):
    text = "0\nchL, chan=0\nchR, chan=1\nsgST, id=a\nggMPg, id=g\nchC, chan=2\nsgM\nggMPg, id=g\nggAPg\nchL, chan=3\n\n2\nchL, chan=0\nsgST, id=a\n"
    got = inserted(spark, text)
    assert [got[k].group for k in (0, 1, 4)] == [2, 2, 5] and got[8].group is None and got[1].channel_id == 2
    assert got[2].groups == [3] and got[5].groups == [3, 7] and not got[6].stored and got[6].label == 3
    assert got[10].stored and got[10].label == 2 and got[10].groups == [3] and got[9].group == 2 and {r.problem for r in got.values()} == {None}


def test_problems(spark):
    text = "0\nchL\nsgST, id=a, MCATitle=x\nggMPg, id=g\n\n1\nsgM\nggMPg\nchX\n\n2\nchR\nsgM, id=a\n\n3\nggAPg\nchC\nsgST, id=a, MCATitle=y\nggAPg\n\n4\nchC\nsgST, id=a\nggAPg, id=h\n"
    got = inserted(spark, text)
    said = {k: r.problem for k, r in got.items() if r.problem}
    assert said == {3: "no channels in a soundfield group", 5: "no such label", 7: "one id for different labels", 8: "no soundfield group before it", 10: "other properties than the first of its id", 13: "other groups than the first of its id"}
    assert not got[5].stored


def test_one_join_of_lines(spark):
    """Besides the symbols, lines meet only the groups above them; a channel's group comes from a window."""
    lines = spark.createDataFrame([(1, 0, 0, "chL", None, True, 0, {})], "file int, track long, seq long, tag string, id string, repeat boolean, channel int, props map<string,string>")
    plan = labels.insert_labels(lines, spark.createDataFrame(SYMBOLS, "tag string, kind string, name string"), "file")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join " in x and "_sgs#" in x]
