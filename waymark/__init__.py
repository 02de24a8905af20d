"""Relative-location analytics on Spark: cleaning, salience, spatial relations, description text, evaluation."""
