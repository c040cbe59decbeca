"""Revenue-cycle episode marts on Spark: raw files to cleaned facts to reporting tables."""
