"""touchline: point-in-time analytics over results, odds and ledgers, written as Spark jobs."""
