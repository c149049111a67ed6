"""Secret scans in DataFrame operations only: fixed patterns, and character Markov models for other random strings.

Two first-order models over character pairs, one of random strings and one of ordinary identifiers, are counted from
labelled samples. A token is a secret if random strings explain it better: the sum of its pairs' log-likelihood
ratios, and their mean, exceed their thresholds.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stage, text_or_empty

#: The base patterns, the group to measure and its least length, in the order that sorts equal starts.
ASSIGN = r"""((?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Ordinary identifiers, labelled so, that are part of every training.
ORDINARY = """accessControlList account_identifier activeConnectionCount addEventListener administrator allocation_strategy annotationProcessor
application_configuration argumentParser asynchronousResponse authenticationManager authorization_header availabilityZone background_color_scheme
batchNormalization beforeTransaction boundary_condition broadcastReceiver buffer_allocation calculateCheckSum cancellationToken certificate_authority
characterEncoding checkpoint_directory clientConnectionPool collection_of_documents commandLineArguments compareAndExchange compression_algorithm
concurrentHashMap configurationProvider connection_string contentDisposition continuousIntegration convertToLowerCase createTemporaryTable
credentialsProvider currentWorkingDirectory customer_relationship_management database_migration_script defaultExceptionHandler dependencyInjection
deserializeObject development_environment dictionaryComprehension disconnectedOperation distributedFileSystem documentation_generator
downloadInformation dynamicProgramming elementaryFunctions emailNotificationService encryptionContext environment_variables errorMessageTemplate
evaluationStrategy eventListenerRegistry exceptionTranslation executionEnvironment expirationTimestamp extensionRegistry external_identifier
featureExtraction fileDescriptorTable filterPredicate foreign_key_constraint frameworkInitialization functionalInterface garbageCollection
generate_random_number getElementById globalInterpreterLock graphicsContext handleIncomingRequest hardwareAcceleration horizontalAlignment
identifierGenerator immutableCollection implementation_detail incrementalCompilation information_retrieval inheritanceHierarchy initialization_vector
inputStreamReader instanceMethod integrationTesting internationalisation interpolateString invalidArgumentException iterationCounter javaScriptEngine
keyboardInterrupt knowledgeManagement language_specification lazyEvaluation leastRecentlyUsed libraryDependencies linearRegression listComprehension
loadBalancerConfiguration localisation_of_messages loggingConfiguration machineLearningPipeline maintenanceWindow managedIdentity matrixMultiplication
maximumRetryAttempts memoryManagement messageBrokerCluster metadataRepository methodInvocation microserviceArchitecture migration_history
modification_timestamp multithreadedExecutor namespaceDeclaration navigationController network_configuration nonBlockingOperation normalisation_factor
notificationCenter numberOfPartitions objectRelationalMapping observablePattern operating_system_release optimisticLocking organisation_unit
packageManagerVersion parallelExecution parameterValidation partition_by_expression performanceCounter permissionDenied persistentVolumeClaim
placeholder_for_translation pointerArithmetic polymorphicAssociation preferredLanguage preprocessorDirective presentationLayer primary_key_column
printStackTrace processInformation programmingLanguage propertyPlaceholder protocolBufferMessage quantityInStock queryOptimizer randomAccessFile
readOnlyTransaction recommendationSystem recursiveDescentParser referenceCounting registrationService regularExpression relationshipManager
remoteProcedureCall repositoryInterface requestDispatcher resource_consumption responseEntity retentionPolicy rollbackTransaction runtimeEnvironment
schedulerConfiguration searchEngineResults securityContextHolder semanticVersioning sequenceGenerator serializationFormat serverSideRendering
sessionManagement shippingAddress simulation_parameters singletonInstance software_engineering sortedByPopularity standardDeviation statisticalAnalysis
storageAccountName stringConcatenation structuredStreaming subscriptionIdentifier synchronizationBarrier systemAdministrator tableOfContents
telemetryCollector temporary_directory terminationCondition testCoverageReport threadLocalStorage timezoneConversion transactionManager
transformationPipeline translationUnit typeInference unauthorizedAccess uniformDistribution universalIdentifier unstructuredInformation
updateStatement userInterfaceComponent validationConstraint variableDeclaration vectorSpaceModel verificationCode virtualMachineImage
visualisation_of_results webApplicationServer whitespaceHandling windowAggregation workflowDefinition""".split()



def ordinary_forms(words: list[str]) -> list[str]:
    """The words as identifiers are written: constants, paths, dated and numbered names, class and method names."""
    parts = [[p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", w)] for w in words]
    n, out = len(words), list(words)
    for i, a in enumerate(parts):
        b, c = parts[(7 * i + 3) % n], parts[(11 * i + 5) % n]
        title = ["".join(p.title() for p in x) for x in (a, b, c)]
        day = f"20{10 + i % 20}-{1 + i % 12:02d}-{1 + i % 28:02d}"
        out += ["_".join(a + b).upper(), "/".join(a + b + c), "-".join([day, *a, b[0]]), "_".join([*b, day.replace("-", "")]), "_".join([*a, str(i % 100), *b]), "-".join(a + b)]
        out += [title[0] + title[1], a[0] + "".join(p.title() for p in (a + b + c)[1:]), f"{title[0]}V{i % 10}{title[1]}", f"/{a[0]}/{b[0]}{i % 10}/{'-'.join(c)}"]
    return out


#: Documents from which ordinary tokens and matched secrets are taken, at most; those with the smallest hashes.
SAMPLE = 2_000
MIN_SUM, MIN_MEAN = 12.0, 0.7


def matches(text: Column, pattern: str, measured: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end) in code points of a pattern's matches whose group `measured` has `least` characters.

    What lies between matches is what split() returns, so starts follow from lengths.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], pattern, measured) if measured else pair["hit"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    return F.aggregate(pairs, start, add, lambda s: s["spans"])


def base_spans(text: Column) -> Column:
    """All base spans of a text; the patterns run only on texts that a cheap test lets through."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    small = F.lower(text)
    named = small.contains("passw") | small.contains("secret") | small.contains("token") | small.contains("api")
    assign = F.when(named & (text.contains(":") | text.contains("=")), matches(text, ASSIGN, 3, 12, 0)).otherwise(none)
    access = F.when(text.contains("AKIA"), matches(text, ACCESS, 0, 18, 1)).otherwise(none)
    # Runs of 16 or more are the whole runs: the pattern with a bound finds the same ones.
    hexes = F.when(text.rlike("[0-9a-f]{16}"), matches(text, HEX.replace("+", "{16,}"), 0, 16, 2)).otherwise(none)
    return F.concat(assign, access, hexes)


def pairs(token: Column) -> Column:
    """Numbers of a token's character pairs; characters outside the alphabet share number 0."""
    size = len(ALPHABET) + 1
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * size + b)


def labelled_samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(token, random): values matched by the base patterns and strings made by rule are random, words without digits
    of the same documents and the fixed identifiers, in all forms that `ordinary_forms` gives, are ordinary. docs: doc_id, text; a bounded sample of documents."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(ids), "doc_id").select(text_or_empty().alias("t"))
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z_]{6,}"), F.lit(0))).alias("token"), F.lit(0).alias("random"))
    hits = texts.select(F.explode(F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 3), (ACCESS, 0), (HEX.replace("+", "{16,}"), 0))])).alias("token"), F.lit(1).alias("random")).where(F.length("token") >= 12)
    made = docs.sparkSession.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rule = made.select(F.explode(F.array(F.col("h"), F.base64(F.unhex("h")), F.upper(F.substring(F.base64(F.unhex("h")), 1, 24)))).alias("token"), F.lit(1).alias("random"))
    fixed = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(" ".join(ordinary_forms(ORDINARY))), " ")).alias("token"), F.lit(0).alias("random"))
    return words.unionByName(hits).unionByName(rule).unionByName(fixed)


def ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, random over ordinary, from counts of samples(token, random)."""
    size = len(ALPHABET) + 1
    counts = samples.select("random", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").count().collect()  # bounded by the alphabet
    table = {(r["random"], r["pair"]): r["count"] for r in counts}

    def logs(kind: int, prior: float = 5.0) -> list[float]:
        """log P(b after a), drawn towards the frequency of b, itself drawn a little towards even."""
        n = [[table.get((kind, a * size + b), 0) for b in range(size)] for a in range(size)]
        total = sum(map(sum, n))
        share = [(sum(row[b] for row in n) + 0.5) / (total + 0.5 * size) for b in range(size)]
        return [math.log((row[b] + prior * share[b]) / (sum(row) + prior)) for row in n for b in range(size)]

    return [r - o for r, o in zip(logs(1), logs(0), strict=True)]


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, sample: int = SAMPLE, min_sum: float = MIN_SUM, min_mean: float = MIN_MEAN) -> DataFrame:
    """Finds secrets in every whole text of docs(doc_id, text).

    Returns one row for each input row: doc_id, base (spans of the fixed patterns) and added (spans of tokens that the
    Markov models call random and no base span touches), both arrays of (start, kind, end) by start, then kind, in
    code points. samples(token, random) train the models; without them they come from docs (`labelled_samples`). Null
    text is empty; a null doc_id is kept; repeated rows get equal answers; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = pick(docs, "doc_id", "text")
    llr = ratios(labelled_samples(docs, sample) if samples is None else samples)
    model = F.split(F.lit(",".join(f"{v:.6f}" for v in llr)), ",").cast("array<double>")  # folded to one constant
    text = F.col("t")
    found = docs.select("doc_id", text_or_empty().alias("t"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    tokens = F.when(text.rlike(TOKEN), matches(text, TOKEN, 0, 20, 3)).otherwise(none)
    found = found.select("doc_id", "t", F.array_sort(base_spans(text)).alias("base"), tokens.alias("tokens"))
    free = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def random(span: Column) -> Column:
        token = F.substring(F.col("t"), span["start"] + 1, span["end"] - span["start"])
        total = F.aggregate(pairs(token), F.lit(0.0), lambda acc, p: acc + F.element_at(model, p + 1))
        return (total >= min_sum) & (total >= min_mean * (span["end"] - span["start"] - 1))

    return found.select("doc_id", "base", F.filter(free, random).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, from `secret_spans`."""
    rows = secret_spans(docs, **options)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
