"""sparkloom: relational operators for post-training and evaluation data on Spark."""
