import inspect

from sieveline import registry
from sieveline.operators import splits as S


def test_queries_search_as_much_as_the_reference(spark, sf, monkeypatch):
    found = {}

    def seen(name, f):
        def run(*args, **named):
            call = inspect.signature(f).bind(*args, **named)
            call.apply_defaults()
            found[name] = call.arguments
            return args[0]

        return run

    monkeypatch.setattr(S, "balanced_split", seen("split", S.balanced_split))
    monkeypatch.setattr(S, "best_halves", seen("halves", S.best_halves))
    registry.QUERIES["balanced_group_split"](spark, sf)
    registry.QUERIES["crossover_halves"](spark, sf)
    assert found["split"]["restarts"] == 300 and found["halves"]["tries"] == 5000
    few, many = (f(spark, sf).select("a", "b") for f in (registry.QUERIES[q] for q in ("knn_candidates", "knn_candidates_15")))
    assert few.exceptAll(many).isEmpty() and many.count() > few.count()
