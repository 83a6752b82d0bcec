"""Message-archive search and analytics as Spark plans."""
