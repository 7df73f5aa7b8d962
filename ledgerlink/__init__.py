"""ledgerlink: accounts-payable matching, import checks and audit reports as Spark jobs."""
