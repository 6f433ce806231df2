"""DataFrame operators: search, ranking, page analysis, datasets, models, evaluation."""
