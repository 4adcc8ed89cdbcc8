"""Live forms of the ordered folds, on keyed state."""
