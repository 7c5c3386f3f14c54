"""Unsupervised text segmentation, lexicon learning and corpus preparation on Spark."""
