"""DataFrame operators: ordering, folds, profiling, features, in-fold
encodings, matrix preparation, metrics, blending, output and run history."""
