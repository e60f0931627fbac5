"""Analytics over company filings and market events, on Spark DataFrames."""
