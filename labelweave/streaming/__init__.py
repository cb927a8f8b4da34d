"""Label edits as a stream: folding, persisting, retrain rounds, scoring."""
