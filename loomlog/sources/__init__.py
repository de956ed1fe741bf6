"""Reading and writing of records and stores."""
