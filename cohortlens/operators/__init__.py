"""DataFrame operators: cohorts, metrics, profiles, features, models, evaluation."""
