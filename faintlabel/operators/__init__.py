"""Row-level operators: labeling, sampling, bags, feature projection, evaluation."""
