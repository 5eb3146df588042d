"""DataFrame operators: profiling, splitting, transforming, scoring, grading, comparing."""
