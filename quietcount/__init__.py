"""quietcount: privacy-preserving web analytics and revenue attribution on PySpark."""
