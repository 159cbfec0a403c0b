"""End-to-end calls, and the queries of the driver contract."""
