import random

import pytest

from tessera.plans.workflow import Workflow, bag_stages, projection_stages, vocabulary_stages


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(1)
    rows = []
    for c in range(3):
        base = "".join(rng.choice("acgt") for _ in range(40))
        for i in range(8):
            s = list(base)
            for _ in range(3):
                s[rng.randrange(40)] = rng.choice("acgt")
            rows.append((f"c{c}_{i}", "".join(s), [f"class{c}"]))
    return spark.createDataFrame(rows, "seq_id string, residues string, classes array<string>")


def quality(tables):
    rows = tables["evaluation"].collect()
    return sum(r["ap"] for r in rows) / len(rows)


def test_vocabulary_workflow_and_its_kept_tables(spark, sequences, tmp_path):
    stages = vocabulary_stages(8, 2, "dna", "edit", n_test=6, increment=10)
    one = Workflow(spark, str(tmp_path), {"sequences": sequences}, {"sequences": "1"})
    assert quality(one.run(stages)) > 0.9 and one.ran == [s.name for s in stages]
    two = Workflow(spark, str(tmp_path), {"sequences": sequences}, {"sequences": "1"})
    two.run(vocabulary_stages(8, 2, "dna", "edit", n_test=6, increment=10, top=3))
    assert two.ran == ["rankings", "evaluation"]
    three = Workflow(spark, str(tmp_path), {"sequences": sequences}, {"sequences": "2"})
    three.run(stages[:2])
    assert three.ran == ["split", "index"]


def test_other_workflows(spark, sequences, tmp_path):
    for stages in (bag_stages(6, 6, "cosine"), projection_stages(8, "dna", "edit", n_test=6)):
        assert quality(Workflow(spark, str(tmp_path), {"sequences": sequences}, {"sequences": "1"}).run(stages)) > 0.9
