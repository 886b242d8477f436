"""Feature plans: op records, the operator registry, plan parsing,
validation and compilation into DataFrame projections."""
