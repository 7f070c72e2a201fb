"""A Spark-native engine that turns source trees and text corpora into queryable index tables."""
