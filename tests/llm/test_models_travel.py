"""Models reach the workers as plain data: the operators run from a folder whose workers cannot import the package."""

import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from attestra.llm import html_extract, language, pseudo_likelihood
from attestra.session import local_session
spark = local_session("2", "travel", **{{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "2g"}})

def importable(batches):
    import importlib.util
    for b in batches:
        found = importlib.util.find_spec("attestra") is not None
        yield from [b] if found else []

assert spark.range(1).mapInArrow(importable, "id long").count() == 0
words = dict(en="the house stands on the hill and the river runs below it", fr="la maison est sur la colline et la riviere coule en bas")
docs = spark.createDataFrame([(i, (words[l] + " ") * 3, l) for i in range(12) for l in words], "doc_id long, text string, lang string")
model = language.learn(docs)
assert all(r.doc.lang == r.lang_pred for r in language.identify(docs, model, carry=["doc_id", "lang"]).collect())
trained = pseudo_likelihood.train(docs, classes=16, inputs=64, bits=8, every=1, rounds=1, steps=2)
assert all(r.n_tokens > 0 and r.log_likelihood < 0 for r in pseudo_likelihood.score(docs, trained).collect())
pages = spark.createDataFrame([(1, "u", "<html><body><p>Some words of an article.</p></body></html>")], "page_id long, url string, html string")
assert len(html_extract.main_text(pages, model=html_extract.train(pages=8, trees=3, depth=2)).collect()) == 1
spark.stop()
print("travelled")
"""


def test_models_travel_as_plain_data(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "travelled" in done.stdout, done.stderr[-3000:]


def test_scans_do_not_grow_with_the_languages(spark):
    from attestra.llm import language

    jobs = set()
    for languages in (2, 6):
        docs = spark.createDataFrame([(i, f"{chr(97 + i % languages) * 4} {chr(107 + i % languages) * 5} word", f"l{i % languages}")
                                      for i in range(60)], "doc_id long, text string, lang string")
        spark.sparkContext.setJobGroup(f"learn {languages}", "learn")
        model = language.learn(docs)
        jobs.add(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"learn {languages}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(model.languages) == languages
        assert all(r.lang_pred == r.doc.lang for r in language.identify(docs, model, carry=["lang"]).collect())
    assert len(jobs) == 1 and 0 < jobs.pop() <= 12
