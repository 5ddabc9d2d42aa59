"""Lost-and-found animal intake analytics on Spark DataFrames."""
