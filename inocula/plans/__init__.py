"""Report plans: the catalogue (Q*), analysis tasks (T*), chart datasets
(V*), ingest checks (L*) and operator runs on the raw testdata tables."""
