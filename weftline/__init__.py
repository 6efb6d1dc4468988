"""Trust, social-graph and text analytics as Spark plans."""
