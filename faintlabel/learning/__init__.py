"""Models: label-regularized logistic regression, baselines, committees, feature ranking."""
