"""specmine: Spark jobs that mine structured records out of large manual collections."""
