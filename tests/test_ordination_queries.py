"""The registered ordination queries run the whole job."""

import inspect

from quadrat.plans import queries_ordination


def test_scores_iterate_to_convergence(spark, monkeypatch):
    """The registered queries pass no bound on rounds or restarts that is below the operators' own."""
    seen = []
    for name in ("pcoa", "kmeans"):
        def noted(*a, _f=getattr(queries_ordination.ordination, name), **k):
            bound = inspect.signature(_f).bind(*a, **k)
            bound.apply_defaults()
            seen.append(bound.arguments)
            return ("scores", [], 0.0) if "rounds" in bound.arguments else None

        monkeypatch.setattr(queries_ordination.ordination, name, noted)
    for name in ("_root", "_members"):
        monkeypatch.setattr(queries_ordination, name, lambda *a: None)
    queries_ordination.kmeans(spark, "")
    assert (seen[0]["rounds"], seen[0]["tolerance"]) == (60, 1e-7) and seen[1]["restarts"] == 100
