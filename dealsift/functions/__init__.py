"""Column functions: every one takes and returns Spark columns, none needs Python on executors."""
