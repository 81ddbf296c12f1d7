"""The star schema's tables as models."""

SCHEMA = """
model Region {
  regionkey Int    @id @map("r_regionkey")
  name      String @map("r_name")
  nations   Nation[]
  @@map("region")
}

model Nation {
  nationkey Int    @id @map("n_nationkey")
  name      String @map("n_name")
  regionkey Int    @map("n_regionkey")
  region    Region @relation(fields: [regionkey], references: [regionkey])
  customers Customer[]
  suppliers Supplier[]
  @@map("nation")
}

model Customer {
  custkey    BigInt @id @map("c_custkey")
  name       String @map("c_name")
  nationkey  Int    @map("c_nationkey")
  acctbal    Float  @map("c_acctbal")
  mktsegment String @map("c_mktsegment")
  nation     Nation @relation(fields: [nationkey], references: [nationkey])
  orders     Order[]
  events     Event[]
  @@map("customer")
}

model Supplier {
  suppkey   BigInt @id @map("s_suppkey")
  name      String @map("s_name")
  nationkey Int    @map("s_nationkey")
  acctbal   Float  @map("s_acctbal")
  nation    Nation @relation(fields: [nationkey], references: [nationkey])
  lines     LineItem[]
  @@map("supplier")
}

model Part {
  partkey     BigInt @id @map("p_partkey")
  name        String @map("p_name")
  brand       String @map("p_brand")
  type        String @map("p_type")
  size        Int    @map("p_size")
  retailprice Float  @map("p_retailprice")
  lines       LineItem[]
  @@map("part")
}

model Order {
  orderkey      BigInt   @id @map("o_orderkey")
  custkey       BigInt   @map("o_custkey")
  orderstatus   String   @map("o_orderstatus")
  totalprice    Float    @map("o_totalprice")
  orderdate     DateTime @map("o_orderdate")
  orderpriority String   @map("o_orderpriority")
  customer      Customer @relation(fields: [custkey], references: [custkey])
  lines         LineItem[]
  @@map("orders")
}

model LineItem {
  orderkey      BigInt   @map("l_orderkey")
  partkey       BigInt   @map("l_partkey")
  suppkey       BigInt   @map("l_suppkey")
  linenumber    Int      @map("l_linenumber")
  quantity      Float    @map("l_quantity")
  extendedprice Float    @map("l_extendedprice")
  discount      Float    @map("l_discount")
  tax           Float    @map("l_tax")
  returnflag    String   @map("l_returnflag")
  linestatus    String   @map("l_linestatus")
  shipdate      DateTime @map("l_shipdate")
  order         Order    @relation(fields: [orderkey], references: [orderkey])
  part          Part     @relation(fields: [partkey], references: [partkey])
  supplier      Supplier @relation(fields: [suppkey], references: [suppkey])
  @@id([orderkey, linenumber])
  @@map("lineitem")
}

model Event {
  event_id   BigInt   @id
  ts         DateTime
  user_id    BigInt
  event_type String
  value      Float
  props      Json
  customer   Customer @relation(fields: [user_id], references: [custkey])
  @@map("events")
}

model Document {
  doc_id  BigInt @id
  lang    String
  source  String
  n_chars BigInt
  label   Label?
  @@map("documents")
}

model Label {
  doc_id   BigInt @id
  quality  Int
  toxic    Int
  document Document @relation(fields: [doc_id], references: [doc_id])
  @@map("labels")
}

model Message {
  conv_id BigInt
  turn    BigInt
  role    String
  text    String
  @@id([conv_id, turn])
  @@map("conversations")
}
"""
