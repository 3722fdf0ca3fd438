"""changelens: change-intelligence operators for Spark (see README.md)."""
