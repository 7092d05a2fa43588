"""Help-desk conversation analytics on Spark: declarative DataFrame plans over message and ticket tables."""
