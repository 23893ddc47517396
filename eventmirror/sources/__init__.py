"""Reading exports and tables, writing results."""
