from codeflux.sources import facts
from codeflux.streaming import refresh


def test_refresh_keeps_the_latest(spark, tmp_path):
    src, store, check = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.py").write_text("def f():\n    return 1\n")
    refresh.refresh(spark, str(src), store, check).awaitTermination()
    (src / "b.py").write_text("def g():\n    return 2\n\ndef h():\n    return g()\n")
    refresh.refresh(spark, str(src), store, check).awaitTermination()
    found = facts.functions(refresh.current(spark, store))
    assert sorted(r.fq for r in found.select("fq").collect()) == ["a.py:f", "b.py:g", "b.py:h"]
