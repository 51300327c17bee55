import random
from pathlib import Path

import corpus_pipeline
from rowtide.llm import common, lines, neardup, suffixes


def corpus(spark):
    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared, near = text(70), [text(30) for _ in range(6)]
    rows = [(k, "\n".join([text(30), *([shared] if k % 3 == 0 else []), near[k % 6].replace("a", "b", k % 4), text(25)]), f"h{k % 5}") for k in range(60)]
    rows += [(100 + k, rows[k][1] + " end", "h1") for k in range(5)] + [(200, "few words", "h2"), (201, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def tables(spark):
    return {p.name for p in Path(common.shared_folder(spark).removeprefix("file://")).iterdir()}


def test_a_stage_leaves_one_small_table(spark, tmp_path):
    docs = corpus(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = tables(spark)
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        left = tables(spark) - before
        assert len(left) == 1 and left.pop().split("-")[0] in ("gone", "groups", "cut"), name
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0


def test_parts_change_no_result(spark, monkeypatch):
    docs = corpus(spark).where("text is not null")
    gone = lambda: sorted(map(tuple, lines.repeated_lines(docs.select("doc_id", "text")).collect()))
    cut = lambda: sorted(map(tuple, suffixes.cut_repeats(docs, words=51).collect()))
    whole = gone(), cut()
    assert whole[0] and whole[1] != sorted(map(tuple, docs.collect()))
    for module, names in ((lines, ("LIST_ROWS", "PAIR_ROWS", "PART_ROWS")), (suffixes, ("PART_ROWS",))):
        for name in names:
            monkeypatch.setattr(module, name, 4)
        monkeypatch.setattr(module, "PARTS", 3)
    assert (gone(), cut()) == whole


def test_near_dedup_makes_its_classes_in_parts(spark, monkeypatch):
    docs, sizes, stash = corpus(spark), [], neardup.stash
    whole = sorted(map(tuple, neardup.groups(docs).drop("h").collect()), key=str)

    def counted(df, tag):
        out = stash(df, tag)
        sizes.extend([out.count()] if tag == "classes" else [])
        return out

    monkeypatch.setattr(neardup, "stash", counted)
    monkeypatch.setattr(neardup, "PART_ROWS", 10, raising=False)
    assert sorted(map(tuple, neardup.groups(docs).drop("h").collect()), key=str) == whole
    assert len(sizes) == 4 and 0 < max(sizes) < 40, sizes
